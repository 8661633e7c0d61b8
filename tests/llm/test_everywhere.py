"""Training-data queries on executors that have no copy of the package."""

from tests.test_everywhere import run_from_empty_folder


def test_every_training_data_query_runs_without_the_package(tmp_path):
    out = run_from_empty_folder(tmp_path, "import __spark_entry__ as entry\nfound = {n: q for n, q in entry.queries().items() if n.startswith('op') and n[2].isdigit() or n == 'pipeline'}")
    assert "RAN 14" in out
