"""The incremental store, the stream and the command line."""

import json

from pyspark.sql import functions as F

from incognita import __main__ as cli
from incognita.operators import rewrite
from incognita.plans.pipeline import Engine
from incognita.streaming import incremental


def test_a_stream_keeps_its_aliases(spark, tmp_path):
    schema = "doc_id long, text string"
    source, store, output = (str(tmp_path / d) for d in ("in", "store", "out"))
    engine = Engine()
    batches = [[(1, "la CAF et URSSAF"), (2, "tel 115")], [(3, "CAF, puis 3646 et MDPH"), (4, "rien")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.pseudonymize_stream(stream, engine, store, output, str(tmp_path / "checkpoint")).awaitTermination()
    found = {r.doc_id: r.text for r in spark.read.parquet(output).collect()}
    assert found == {1: "la <ORG_CAF_1> et <ORG_PUBLIC_NAT_1>", 2: "tel <PHONE_1>", 3: "<ORG_CAF_1>, puis <PHONE_2> et <ORG_MDPH_1>", 4: "rien"}
    again = {r.doc_id: r.text for r in incremental.rewrite_batch(engine, spark.createDataFrame(batches[1], schema), store, 1).collect()}
    assert again == {i: found[i] for i in again}
    aliases = incremental.store_before(spark, store, 9).collect()
    assert len({a.alias for a in aliases}) == len({a.original for a in aliases}) == len(aliases) == 5


def test_rules_and_model_of_the_command_line(spark, tmp_path):
    text, out, rules = (tmp_path / n for n in ("a.txt", "b.txt", "r.yaml"))
    text.write_text("Ana va à la CAF, Orion", encoding="utf-8")
    rules.write_text("\ufefforg_regex:\n  ORG_OWN: ['\\bOrion\\b']\n", encoding="utf-8")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "g.csv").write_text("name,category\nxyz,ORG_X\n", encoding="utf-8")
    where = ["--input", str(text), "--output", str(out), "--gazetteers", str(tmp_path / "none")]
    assert cli.main([*where, "--rules", str(rules)]) == 0
    assert out.read_text(encoding="utf-8") == "Ana va à la CAF, <ORG_OWN_1>"
    assert cli.main([*where, "--more-rules", str(rules), "--model", "incognita.plans.fixtures:leading_word"]) == 0
    assert out.read_text(encoding="utf-8") == "<PER_1> va à la <ORG_CAF_1>, <ORG_OWN_1>"


def test_corpus_numbers_are_dense(spark):
    rows = [(d, s, f"x{(d * 7 + s) % 40}", "A" if (d * 7 + s) % 40 < 36 else "B") for d in range(30) for s in range(4)]
    found = rewrite.corpus_aliases(spark.createDataFrame(rows, "doc_id long, start int, text string, prefix string"), blocks=4).collect()
    for prefix in "AB":
        assert sorted(r.n for r in found if r.prefix == prefix) == list(range(1, 1 + sum(r.prefix == prefix for r in found)))
    assert len(found) == len({r.original for r in found})


def test_command_line(spark, tmp_path):
    text, out, mapping, back = (tmp_path / n for n in ("a.txt", "b.txt", "m.json", "c.txt"))
    text.write_text("la CAF de Paris, tel 115", encoding="utf-8")
    assert cli.main(["--input", str(text), "--output", str(out), "--mapping", str(mapping)]) == 0
    assert out.read_text(encoding="utf-8") == "la <ORG_CAF_1>, tel <PHONE_1>"
    assert json.loads(mapping.read_text(encoding="utf-8"))["stats"] == {"total_entities": 2, "per_type": {"ORG_CAF": 1, "PHONE": 1}}
    assert cli.main(["--input", str(out), "--output", str(back), "--load-mapping", str(mapping), "--depseudonymize"]) == 0
    assert back.read_text(encoding="utf-8") == "la CAF de Paris, tel 115"
    text.write_text("tel 3646 et 115", encoding="utf-8")
    assert cli.main(["--input", str(text), "--output", str(out), "--load-mapping", str(mapping)]) == 0
    assert out.read_text(encoding="utf-8") == "tel <PHONE_2> et <PHONE_1>"
    assert cli.main(["--input", str(text), "--output", str(out), "--depseudonymize"]) == 1


def test_restoring_an_empty_table(spark):
    df = spark.createDataFrame([("a <X_1>",)], "t string")
    assert df.select(rewrite.restored(F.col("t"), F.array().cast(rewrite.ALIASES)).alias("r")).first().r == "a <X_1>"
