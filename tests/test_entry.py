import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_can_be_named_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 80


def test_core_does_not_import_the_llm_package():
    for p in (ROOT / "lacuna").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lacuna.llm" not in p.read_text()


def test_core_queries_survive_an_llm_package_that_cannot_be_imported():
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['regex'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 80
