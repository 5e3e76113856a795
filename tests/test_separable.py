"""The library without its optional subpackage: entry points import and list the other queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_imports_without_the_text_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "inkmesh", tmp_path / "inkmesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'cooc_brand_assoc' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
