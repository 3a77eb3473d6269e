import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_training_data_operators():
    inside = {ROOT / "noetica/llm", ROOT / "tests/llm"}
    files = [p for p in ROOT.rglob("*.py") if not inside & set(p.parents) and p.name not in ("__spark_entry__.py", "corpus_pipeline.py", Path(__file__).name)]
    assert files and not [p for p in files if re.search(r"noetica\.llm|corpus_pipeline", p.read_text())]


def test_every_query_has_a_name_and_most_an_oracle():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 70
