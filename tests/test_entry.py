"""The entry file works whether or not the operators for training text are there."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["borewatch.llm", "borewatch.llm.registered", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_entry_without_a_module(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert len(names) > 100 and set(e.oracle_sql()) <= names\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in names), 'nothing of a part that cannot be imported'\n"
    )
    env = {**os.environ, "PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
