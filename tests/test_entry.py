import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("catalink.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert len(names) >= 80 and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_the_library_works_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for folder in ("catalink", "workload"):
        for path in (ROOT / folder).rglob("*.py"):
            if "llm" not in path.relative_to(ROOT).parts:
                assert "llm" not in path.read_text(), path
