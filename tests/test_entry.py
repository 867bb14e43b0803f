"""The driver's contract, with or without the training-data operators."""

import __spark_entry__ as entry


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) >= 48 and "convert_documents" in oracle
    assert entry.entry(spark).count() == 200
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit())
    assert numbers in ([], list(range(1, 11)))
    assert ("pipeline" in queries) == bool(numbers)
