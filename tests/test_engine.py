"""The engine against hand-derived cases, its reference SQL, a plain fold and invariants."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from incognita.functions import text as texts
from incognita.functions.spans import spans
from incognita.operators import classify, detect, ner, resolve, rewrite
from incognita.operators.entities import ENTITIES, FIELDS
from incognita.plans import fixtures, registry
from incognita.plans.pipeline import Engine
from incognita.sources import catalog, lexicon, readers

# id, text, annotations (start, end, label) in the normalized text, expected output
CASES = [
    (1, "Contact : a.b@ex.fr ou 06.12.34.56.78", [], "Contact : <EMAIL_1> ou <PHONE_1>"),
    (2, "Tel 115 et 3646", [], "Tel <PHONE_2> et <PHONE_1>"),
    (3, "admis en 1978", [], "admis en <PHONE_1>"),
    (4, "Un EHPAD du quartier", [], "Un EHPAD du quartier"),
    (5, "L'EHPAD Sainte-Gertrude accueille", [(8, 23, "LOC")], "L'<ETAB_EHPAD_1> accueille"),
    (6, "SESSAD « Arc-en-Ciel »", [(8, 19, "LOC")], "<ETAB_SESSAD_1> "),
    (7, "la CAF de Paris.", [], "la <ORG_CAF_1>."),
    (8, "avec ARS hier", [], "avec <ORG_PUBLIC_TERR_1> hier"),
    (9, "MDPH de Lyon 3", [], "MDPH de Lyon 3"),
    (10, "CAF, puis CAF.", [], "<ORG_CAF_1>, puis <ORG_CAF_1>."),
    (11, "le Conseil Départemental, hier", [], "le Conseil Départemental, hier"),
    (12, "chez Google", [], "chez <ETAB_1>"),
    (13, "vu par Dr LEMOINE", [(10, 17, "PER")], "vu par Dr <PROFESSION_1>"),
    (14, "vu par Dr. LEMOINE", [(11, 18, "PER")], "vu par Dr. <PER_1>"),
    (15, "habite 59800 Lille", [(7, 18, "LOC")], "habite <ADDR_FULL_1>"),
    (16, "vient de Lyon", [(9, 13, "LOC")], "vient de <LOC_CITY_1>"),
    (17, "le SAAD passe", [], "le SAAD passe"),
    (18, "SS: 1 65 03 75 123 456 78", [], "SS: <NIR_1>"),
    (19, "", [], ""),
    (20, None, [], ""),
    (21, "   \n\t ", [], "   \n\t "),
    (22, "CAF " * 4000, [], "<ORG_CAF_1> " * 4000),
]


@pytest.fixture(scope="module")
def cases(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in CASES], "doc_id long, text string, entities string")
    notes = spark.createDataFrame([(i, a, b, label, 1.0) for i, _, n, _ in CASES for a, b, label in n], "doc_id long, start int, end int, label string, score double")
    return ner.annotated(docs, notes)


def test_hand_derived_cases(cases):
    done = {r.doc_id: r for r in Engine(backend=None).pseudonymized(cases).select("doc_id", "output", "text", rewrite.restored(F.col("output"), F.col("aliases")).alias("restored")).collect()}
    for i, _, _, expected in CASES:
        assert done[i].output == expected, i
        assert done[i].restored == done[i].text


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Engine().pseudonymized(docs).count() == 0
    assert Engine().by_occurrence(docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "CAF"), (None, "CAF"), (1, "CAF"), (1, "CAF")], "doc_id long, text string")
    assert [r.output for r in Engine().pseudonymized(docs).collect()] == ["<ORG_CAF_1>"] * 4


def test_the_catalog_has_all_patterns():
    assert len(catalog.rules("repaired")) == 196 and len(catalog.rules("faithful")) == 193
    for r in catalog.rules("repaired"):
        re.compile(r.pattern)


def test_repaired_rules_find_accented_names(spark):
    docs = spark.createDataFrame([(1, "la Préfecture et le Conseil départemental du Nord"), (2, "Croix-Rouge française, Œuvre de la Miséricorde")], "doc_id long, text string")
    found = {e.text for r in Engine(profile="repaired", gazetteers={}).resolved(docs).collect() for e in r.entities}
    assert {"Préfecture", "Croix-Rouge française", "Œuvre de la Miséricorde"} <= found


def test_queries_equal_their_reference_sql(spark, sf_dir):
    """Every query with reference SQL, over the smallest tables."""
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) == set(queries)

    for name in queries:
        df = queries[name](spark, sf_dir)
        columns = sorted(df.columns)
        found = [tuple(r) for r in df.select(*columns).collect()]
        expected = db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql[name]})").fetchall()
        assert sorted(map(repr, map(_loose, found))) == sorted(map(repr, map(_loose, expected))), name


@pytest.mark.parametrize("name", ["rules_geo_extended", "candidate_union", "gazetteer_join"])
def test_a_texts_words_are_parted_once_for_all_rules(spark, sf_dir, name):
    """Rules are chosen by words at hand: taking them from the text there would part it once for each rule."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    chosen = re.findall(r"arrays_overlap\(([^()]*)([()])", plan)
    assert chosen and all(end == ")" for _, end in chosen)


def test_places_are_sought_once_for_each_match(spark, sf_dir):
    """One operator seeks them; a condition or a column above it would seek them again."""
    plan = registry.queries()["rules_geo_extended"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(lexicon.GEO in line for line in plan.splitlines()) == 1


def _loose(row):
    return tuple(round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)


def plain_resolve(entities, priority):
    """Another writing of the fold: accepted entities, longest first, then priority."""
    kept = []
    for e in sorted(entities, key=lambda x: (x["start"], x["seq"])):
        rivals = []
        for k in kept:
            shared = min(e["end"], k["end"]) - max(e["start"], k["start"])
            if shared > 0 and shared / min(e["end"] - e["start"], k["end"] - k["start"]) > 0.3:
                rivals.append(k)
        size = lambda x: x["end"] - x["start"]
        if any(size(k) > size(e) if abs(size(k) - size(e)) > 3 else priority[k["source"]] >= priority[e["source"]] for k in rivals):
            continue
        kept = [k for k in kept if k not in rivals] + [e]
    return sorted((k["start"], k["seq"]) for k in kept)


def test_resolution_equals_a_plain_fold(spark):
    draw, docs = random.Random(8), []
    priority = {"RULES": 9.5, "GAZETTEER": 9.0, "NER": 2.5}
    for d in range(60):
        entities = []
        for seq in range(draw.randrange(12)):
            start = draw.randrange(30)
            source = draw.choice(list(priority))
            label = {"RULES": "PHONE", "GAZETTEER": "ORG", "NER": "PER"}[source]
            entities.append({"start": start, "seq": seq, "end": start + draw.randrange(1, 14), "text": "x", "label": label, "source": source, "category": "PHONE" if source == "RULES" else None, "score": 1.0})
        docs.append((d, [tuple(e[k] for k in FIELDS) for e in entities], plain_resolve(entities, priority)))
    df = spark.createDataFrame([(d, e) for d, e, _ in docs], f"doc_id long, entities {ENTITIES}").withColumn("once", resolve.resolved(F.col("entities")))
    found = {r.doc_id: r for r in df.withColumn("twice", resolve.resolved(F.col("once"))).collect()}
    for d, _, expected in docs:
        assert [(e.start, e.seq) for e in found[d].once] == expected
        assert found[d].twice == found[d].once


def test_aliases_are_one_to_one_and_spans_apart(spark, sf_dir):
    for r in Engine().pseudonymized(registry.inputs(spark, sf_dir)).collect():
        assert len({a.alias for a in r.aliases}) == len({a.original for a in r.aliases}) == len(r.aliases)
        for prefix in {a.prefix for a in r.aliases}:
            assert sorted(a.n for a in r.aliases if a.prefix == prefix) == list(range(1, 1 + sum(a.prefix == prefix for a in r.aliases)))
        places = sorted((e.start, e.end) for e in r.entities)
        assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))


def test_spans_equal_finditer(spark):
    rows = ["", None, "a1 b22 é333", "😀12 34", "77", "x", "1 2 3" * 50, "1 " * 512, "1 " * 513, "é7 " * 40000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", spans(F.col("t"), F.lit(r"\d+")).alias("s"))
    for r in df.collect():
        expected = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", rows[r.i] or "")]
        assert [tuple(x) for x in r.s] == expected


def test_normalization(spark):
    rows = ["« e\u0301tude »", "l’ami `x` “y” – z\u00a0w", None, "", "Ångström \u212b", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", texts.normalize(F.col("t")).alias("n"), texts.fold_for_matching(F.col("t")).alias("f"))
    found = {r.i: (r.n, r.f) for r in df.collect()}
    assert found[0][0] == " étude " and found[1][0] == "l'ami 'x' \"y\" - z w" and found[2] == (None, None)
    assert found[4] == ("Ångström Å", "angstrom a") and found[5] == ("plain", "plain")


def test_establishment_names_and_predicates(spark):
    df = spark.createDataFrame([("Les Lilas", ""), ("Le Paris", ""), ("Bobo", "qui accueille"), ("Bobo", "")], "n string, c string")
    assert [r.x for r in df.select(classify.is_establishment_name(F.col("n"), F.col("c")).alias("x")).collect()] == [True, False, True, False]


def test_person_predicates(spark):
    rows = [("Jean DUPONT", "par mme jean dupont hier"), ("A. Martin", "rien"), ("le chat", "le chat, directeur"), ("Anne Marie Curie", "a 12 ans, dit")]
    df = spark.createDataFrame(rows, "n string, c string").select(classify.is_person_name(F.col("n")).alias("p"), classify.has_person_context(F.col("c"), F.col("n")).alias("x"))
    assert [tuple(r) for r in df.collect()] == [(True, True), (True, False), (False, True), (True, True)]


def test_chunks_move_by_their_lengths(spark):
    text = ". ".join(" ".join(["mot"] * 30) for _ in range(40))
    found = spark.createDataFrame([(text,)], "t string").select(ner.chunks(F.col("t")).alias("c")).first().c
    assert len(found) > 1 and all(c.text.endswith(".") for c in found) and found[1].start == found[0].end + 1
    sentences = spark.createDataFrame([("Un. Deux! Trois?",)], "t string").select(ner.sentences(F.col("t")).alias("c")).first().c
    assert [c.text for c in sentences] == ["Un.", "Deux!", "Trois?"] and [c.start for c in sentences] == [0, 4, 10]


def _by_value():
    """A loader that workers get by value, as they can't import tests."""

    def load():
        def model(batch):
            if "boom" in batch[0]:
                raise RuntimeError
            return [[{"entity_group": "PER", "start": 0, "end": 3, "score": 0.5}, {"entity_group": "PER", "start": None, "end": 2}] for _ in batch]

        return model

    return load


def test_the_engine_takes_a_model(spark):
    far = ". ".join(["mot " * 200] * 4)
    rows = [(1, "Ana va à la CAF"), (2, "boom CAF"), (3, None), (4, ""), (4, far), (None, "Ana")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, sorted((e.start, e.text, e.source) for e in r.entities)) for r in Engine(backend=ner.model_backend(_by_value()), gazetteers={}).resolved(docs).collect()]
    expected = [(1, [(0, "Ana", "NER"), (12, "CAF", "RULES")]), (2, [(5, "CAF", "RULES")]), (3, []), (4, []), (4, [(0, "mot", "NER"), (far.index("mot", 1603), "mot", "NER")]), (None, [(0, "Ana", "NER")])]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_model_backend(spark):
    load = _by_value()
    chunks = spark.createDataFrame([(1, "Ana va", 10), (2, "boom", 0)], "doc_id long, chunk_text string, chunk_start int")
    assert [tuple(r) for r in ner.by_model(chunks, load).collect()] == [(1, 10, 13, "PER", 0.5)]


def test_gazetteers_of_any_size(spark):
    """More names than a plan may hold: found like those of a constant, in order, whichever way they come."""
    many = {"towns": [(f"Ville {k}", "ORG_TOWN") for k in range(detect.LITERAL_ENTRIES)], "b": [("le Parc", "ETAB_X"), ("@home", "ORG_Y"), ("Ville 7", "ETAB_Z"), ("Z", "ETAB_CP")]}
    rows = [(1, "Ville 7 et ville 12, le Parc"), (1, "Ville 7 et ville 12, le Parc"), (2, None), (3, "écrire @home x@home Z"), (None, "Ville 49999")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("names", F.lit("clash"))

    def found(gazetteers):
        return sorted((repr(r.doc_id), [(e.start, e.text, e.category) for e in r.entities]) for r in Engine(gazetteers=gazetteers, shipped=False, backend=None).candidates(docs).collect())

    few = {"towns": [(f"Ville {k}", "ORG_TOWN") for k in (12, 4999, 7)], "b": many["b"]}
    expected = found(few)
    assert [x for _, x in expected if x][0] == [(21, "le Parc", "ETAB_X"), (0, "Ville 7", "ETAB_Z"), (11, "ville 12", "ORG_TOWN"), (0, "Ville 7", "ORG_TOWN")]
    assert found(many) == found(readers.gazetteer_table(spark, many)) == found(readers.gazetteer_table(spark, few))
    assert [(i, sorted(x)) for i, x in found(many)] == [(i, sorted(x)) for i, x in expected]


def test_stages_are_counted(spark):
    docs = spark.createDataFrame([(1, "la CAF de Paris, tel 115, un EHPAD"), (2, None)], "doc_id long, text string")
    # two rules find the type, which then goes; a rule and a gazetteer find the fund
    found = {r.stage: r.entities for r in Engine(backend=None).counted(docs).collect()}
    assert found == {"candidates": 5, "filtered": 5, "classified": 5, "fused": 3, "resolved": 2, "applied": 2, "skipped": 0}
    assert {r.entities for r in Engine().counted(docs.limit(0)).collect()} == {0}


def test_rules_may_replace_the_shipped_ones(spark):
    docs = spark.createDataFrame([(1, "CAF, Orion")], "doc_id long, text string")
    extra = {"org_regex": {"ORG_OWN": [r"\bOrion\b"]}}
    assert [r.output for r in Engine(extra=extra, shipped=False, backend=None, gazetteers={}).pseudonymized(docs).collect()] == ["CAF, <ORG_OWN_1>"]


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("un\n\ndeux", encoding="utf-8")
    assert readers.read_texts(spark, str(tmp_path / "t")).first().text == "un\n\ndeux"
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.csv").write_text("name,category,reason\n Foo ,ORG_X,because\n,ORG_Y,\n", encoding="utf-8")
    (tmp_path / "g" / "two.csv").write_text("keyword,category\nBar,ETAB_Z\n", encoding="utf-8")
    (tmp_path / "g" / "three.csv").write_text("other\nx\n", encoding="utf-8")
    assert {tuple(r) for r in readers.read_gazetteers(spark, str(tmp_path / "g")).collect()} == {("one", "Foo", "ORG_X"), ("two", "Bar", "ETAB_Z")}
    (tmp_path / "d").mkdir()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d" / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>un</w:t></w:r></w:p><w:p><w:r><w:t>de</w:t><w:t>ux</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d" / "y.docx").write_bytes(b"no zip")
    assert {r.text for r in readers.read_docx(spark, str(tmp_path / "d")).collect()} == {"un\ndeux", None}
    rules = readers.read_rules("date_regex:\n  DATE:\n    - '\\d{4}'\n    - '['\nnope:\n  X: ['a']\nnir_regex:\n  BAD: ['(']\n")
    assert rules == {"date_regex": {"DATE": [r"\d{4}"]}}
    entries = spark.createDataFrame([(1, *k) for k in fixtures.KNOWN], "doc_id long, original string, alias string, prefix string, n long")
    value = readers.mapping_json(entries, "doc_id").first().value
    assert json.loads(value)["counters"] == {"ORG_CAF": 1, "PHONE": 7} and json.loads(value)["stats"]["total_entities"] == 2
    (tmp_path / "m.json").write_text(value, encoding="utf-8")
    assert {tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "m.json")).collect()} == set(fixtures.KNOWN)


def test_lists_are_whole():
    assert len(set(lexicon.CITIES)) == 102 and len(set(lexicon.STOPWORDS)) == 22 and len(lexicon.EXCLUSIONS) == 18


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'rules_org' in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
