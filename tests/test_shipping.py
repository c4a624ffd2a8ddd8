import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from graphloom.session import local_session
from graphloom.extract.frames import extract_files
spark = local_session(2, 2, "1g")
df = spark.createDataFrame([("a.go", "go", b"package a\\nfunc F() {{}}\\n")], "path string, language string, content binary")
print("records", extract_files(df).first().records[0].name)
"""


def test_workers_need_no_installation(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "records F" in out.stdout, out.stderr[-2000:]
