"""The entry module on a copy of the repository without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def _copy(to: Path, *left_out: str) -> Path:
    skip = {str(REPO / name) for name in (".git", *left_out)}
    shutil.copytree(REPO, to, ignore=lambda folder, names: [
        n for n in names if n == "__pycache__" or str(Path(folder) / n) in skip])
    return to


def _listed(repo: Path) -> tuple[list[str], list[str]]:
    out = subprocess.run([sys.executable, "-c", LIST], cwd=repo, capture_output=True, text=True, timeout=120, check=True)
    return tuple(eval(line) for line in out.stdout.splitlines())


@pytest.mark.parametrize("left_out", [("lakehealth/llm", "tests/llm"),
                                      ("lakehealth/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_optional_folders(tmp_path, left_out):
    import __spark_entry__ as entry
    keys, oracles = _listed(_copy(tmp_path / "copy", *left_out))
    assert keys == sorted(entry.ALWAYS) and oracles == sorted(entry.ORACLES)


def test_an_error_inside_the_subpackage_is_not_hidden(tmp_path):
    repo = _copy(tmp_path / "copy")
    if not (repo / "lakehealth/llm/queries.py").exists():
        pytest.skip("without the optional subpackage")
    (repo / "lakehealth/llm/queries.py").write_text("import lakehealth.no_such_part\n")
    with pytest.raises(subprocess.CalledProcessError):
        _listed(repo)
