"""No function has a variable of its own under a name that its module imports or defines and that the function calls."""

import ast
import pathlib

import pytest

ROOT = pathlib.Path(__file__).parent.parent


@pytest.mark.parametrize("path", sorted((ROOT / "stringloom").rglob("*.py")), ids=lambda p: str(p.relative_to(ROOT)))
def test_called_names_are_not_assigned(path):
    tree = ast.parse(path.read_text())
    known = {(a.asname or a.name).split(".")[0] for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    known |= {n.name for n in tree.body if isinstance(n, ast.FunctionDef)}
    for f in (n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)):
        own = {n.id for n in ast.walk(f) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        called = {n.func.id for n in ast.walk(f) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
        assert not own & known & called, f.name
