import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


def test_entry_without_the_operators_folder(tmp_path):
    """With the operators' folder gone, and with the pipeline gone as well, the other queries are there."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tuplewright", tmp_path / "tuplewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        count, found = out.stdout.split()
        assert int(count) > 70 and found == "False"
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
