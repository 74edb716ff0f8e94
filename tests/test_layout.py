"""The training-data subpackage is optional: the rest imports without it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_rest_imports_without_the_subpackage():
    code = "import sys; sys.modules['memlake.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'hybrid_search' in e.queries() and not any(q[:2] == 'op' and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("memlake/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "memlake.llm" not in path.read_text(), path
