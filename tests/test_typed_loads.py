"""Types that hold from load to load: columns no rule types widen and never stop a build or a stream."""

import pytest

from sondage.functions.cast import widest
from sondage.operators.store import SchemaEvolutionError, read_keyed, write_keyed
from sondage.plans.build import build_flat, build_held, run_build_plan
from sondage.streaming.stream import build_stream, land_files

SCHEMA = "survey string, id string, submitted bigint, version string, data string"
VALUES = {"int": "1", "float": "1.5", "text": '"x"', "null": "null", "none": None}


def raw(spark, *values, at=0):
    """A row for each JSON value of the key ``q`` (None: without the key)."""
    rows = []
    for k, v in enumerate(values):
        more = "" if v is None else f', "q": {v}'
        rows.append(("s", f"r{at + k}", 10, "25-1-1", f'{{"ID": "r{at + k}"{more}}}'))
    return spark.createDataFrame(rows, SCHEMA)


def load(spark, path, rows, profile=None):
    flat, kinds = build_held(rows, profile or {})
    return write_keyed(spark, path, flat, ["survey", "id"], kinds=kinds)


def content(df):
    return dict(df.dtypes).get("q"), {r["id"]: r.asDict().get("q") for r in df.collect()}


def test_widest():
    assert widest([]) == widest(["null"]) == "null"
    assert widest(["int", "null"]) == "int"
    assert widest(["float", "int"]) == "float"
    assert widest(["int", "text", "float"]) == "text"


def test_second_load_widens(spark, tmp_path):
    cases = [("int", "float", "double"), ("float", "int", "double"), ("int", "text", "string"), ("text", "float", "string"),
             ("null", "int", "bigint"), ("int", "null", "bigint"), ("none", "float", "double")]
    path = str(tmp_path / "t")
    for at in (0, 1):
        more = "".join(f', "q{k}": {VALUES[c[at]]}' for k, c in enumerate(cases) if VALUES[c[at]] is not None)
        rows = spark.createDataFrame([("s", f"r{at}", 10, "25-1-1", f'{{"ID": "r{at}"{more}}}')], SCHEMA)
        assert load(spark, path, rows) == 1
    df = read_keyed(spark, path)
    rows = sorted(df.collect(), key=lambda r: r["id"])
    for k, case in enumerate(cases):
        assert dict(df.dtypes)[f"q{k}"] == case[2]
        plain = {"bigint": int, "double": float, "string": str}[case[2]]
        for at in (0, 1):
            v = VALUES[case[at]]
            assert rows[at][f"q{k}"] == (None if v in (None, "null") else plain(v.strip('"')))


def test_any_order_equals_one_build(spark, tmp_path):
    values = ["1", "2.5", '"x"']
    want = content(build_flat(raw(spark, *values), {}))
    for n, order in enumerate([(0, 1, 2), (2, 0, 1), (1, 2, 0)]):
        path = str(tmp_path / f"t{n}")
        for k in order:
            load(spark, path, raw(spark, values[k], at=k))
        assert content(read_keyed(spark, path)) == want


def test_numbers_beyond_64_bits_are_no_whole_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, raw(spark, "7"))
    load(spark, path, raw(spark, "92233720368547758070", at=1))
    assert content(read_keyed(spark, path)) == ("double", {"r0": 7.0, "r1": 9.223372036854775807e19})


def test_rules_decide_before_kinds(spark, tmp_path):
    path = str(tmp_path / "t")
    as_text = {"schema": {"q": "text"}}
    load(spark, path, raw(spark, "null"), as_text)
    load(spark, path, raw(spark, "1", at=1), as_text)
    assert content(read_keyed(spark, path)) == ("string", {"r0": None, "r1": "1"})
    path = str(tmp_path / "off")
    load(spark, path, raw(spark, "1"), {"infer_numbers": False})
    assert content(read_keyed(spark, path)) == ("string", {"r0": "1"})


def test_custom_function_leaves_text(spark, tmp_path):
    from pyspark.sql import functions as F

    from sondage.plans.build import Custom
    path = str(tmp_path / "t")
    mark = Custom("mark", fn=lambda df: df.withColumn("q", F.concat(F.lit("n"), "q")))
    load(spark, path, raw(spark, "1"), {"processors": [mark]})
    load(spark, path, raw(spark, "2.5", at=1), {"processors": [mark]})
    assert content(read_keyed(spark, path)) == ("string", {"r0": "n1", "r1": "n2.5"})


def test_replace_and_repeated_load(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, raw(spark, "1", "2"))
    assert load(spark, path, raw(spark, "1", "2")) == 0
    flat, kinds = build_held(raw(spark, "2.5", at=1), {})
    write_keyed(spark, path, flat, ["survey", "id"], "replace", kinds=kinds)
    assert content(read_keyed(spark, path)) == ("double", {"r0": 1.0, "r1": 2.5})
    record = spark.read.schema("column string, kind string").json(f"{path}/_kinds").where("column = 'q'").collect()
    assert sorted(r["kind"] for r in record) == ["float", "int"]  # a load that adds no kind adds no record


def test_types_of_rules_still_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, raw(spark, "1"))
    with pytest.raises(SchemaEvolutionError):
        write_keyed(spark, path, spark.createDataFrame([("s", "r9", True)], "survey string, id string, q boolean"), ["survey", "id"])


def test_empty_load(spark, tmp_path):
    path = str(tmp_path / "t")
    assert load(spark, path, raw(spark, "1").limit(0)) == 0
    load(spark, path, raw(spark, "1"))
    assert content(read_keyed(spark, path)) == ("bigint", {"r0": 1})


def test_stream_and_plan_go_on(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "flat")
    for k, v in enumerate(("1", "1.5", '"x"', "null")):
        land_files(raw(spark, v, at=k), f"{src}/part={k}")
        build_stream(spark, f"{src}/part=*", table, {})
    assert content(read_keyed(spark, table)) == ("string", {"r0": "1", "r1": "1.5", "r2": "x", "r3": None})
    plan = {"surveys": {"s": None}}
    for k, v in enumerate(("null", "1", "1.5")):
        run_build_plan(spark, raw(spark, v, at=k), plan, str(tmp_path / "plan"))
    flat = next(p for p in (tmp_path / "plan").iterdir() if (p / "_kinds").exists())
    assert content(read_keyed(spark, str(flat))) == ("double", {"r0": None, "r1": 1.0, "r2": 1.5})
