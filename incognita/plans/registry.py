"""The engine's named queries and their reference SQL.

Each query runs over the whole ``documents`` table and the fixture documents, which hold what invented prose lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.spans import hits
from ..operators import classify, detect, ner, resolve, rewrite
from ..operators.entities import let, rows
from ..sources import catalog, lexicon, readers
from . import fixtures, oracle
from .pipeline import Engine

ENGINE = Engine(extra=fixtures.EXTRA_RULES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the table."""
    return readers.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and the fixture documents, with the annotations of the latter."""
    own = ner.annotated(fixtures.documents(spark), fixtures.annotations(spark))
    return documents(spark, sf_dir).withColumn("ner", F.array().cast(ner.ANNOTATIONS)).unionByName(own.select("doc_id", "text", "ner"))


def listed(docs: DataFrame, condition: Column | None = None, *more: Column) -> DataFrame:
    """Entities as rows with plain columns."""
    found = rows(docs)
    found = found.where(condition) if condition is not None else found
    return found.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("text").alias("entity"), "label", "source", "category", *more)


# --- sources and text ---------------------------------------------------------------------------------------------


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their lengths."""
    return documents(spark, sf_dir).select("doc_id", "text", F.length("text").cast("long").alias("n_code_points"))


def gazetteer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of a folder of CSV files: the shipped gazetteers and untidy ones."""
    folder = readers.scratch(spark, "gazetteers")
    shipped = {g: "name,category\n" + "".join(f'" {n} ",{c} \n' for n, c in entries) for g, entries in lexicon.GAZETTEERS.items()}
    for name, content in {**shipped, **fixtures.CSV}.items():
        readers.write_file(spark, f"{folder}/{name}.csv", content)
    return readers.read_gazetteers(spark, folder)


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and patterns in force by family, with the rules of a YAML file beside the shipped ones."""
    path = readers.write_file(spark, readers.scratch(spark, "rules") + ".yaml", fixtures.YAML)
    rules = catalog.rules(extra=readers.read_rules(readers.read_file(spark, path)))
    table = spark.createDataFrame([(r.family, r.category, r.pattern) for r in rules], "family string, category string, pattern string")
    return table.groupBy("family").agg(F.count_distinct("category").alias("n_categories"), F.count("*").alias("n_patterns"))


def mapping_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping file's entries, with prefixes and numbers read off the aliases."""
    return readers.read_mapping(spark, readers.write_file(spark, readers.scratch(spark, "mapping") + ".json", fixtures.JSON))


def restore_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the aliases of a mapping file at their ends, restored by it."""
    one = F.sort_array(F.collect_list(F.struct("original", "alias", "prefix", "n"))).alias("aliases")
    table = F.broadcast(mapping_load(spark, sf_dir).agg(one))
    marked = ENGINE.normalized(inputs(spark, sf_dir)).select("doc_id", F.concat("text", F.lit(" <PHONE_7>, <ORG_CAF_1> <PHONE_70> <ETAB_A_12>")).alias("text"))
    return marked.crossJoin(table).select("doc_id", rewrite.restored(F.col("text"), F.col("aliases")).alias("text"))


def docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a folder of DOCX files, one of which isn't one."""
    folder = readers.scratch(spark, "docx")
    readers.write_file(spark, f"{folder}/a.docx", fixtures.docx())
    readers.write_file(spark, f"{folder}/b.docx", b"no archive")
    return readers.read_docx(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "text")


def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized texts, written and read back."""
    path = readers.scratch(spark, "texts")
    readers.write_texts(ENGINE.normalized(inputs(spark, sf_dir)), path)
    return spark.read.parquet(path)


def mapping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents' mappings by prefix."""
    done = ENGINE.pseudonymized(inputs(spark, sf_dir)).select("doc_id", F.explode("aliases").alias("a"))
    return done.groupBy(F.col("a.prefix").alias("prefix")).agg(F.count("*").alias("total"), F.max("a.n").alias("highest"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized texts."""
    return ENGINE.normalized(inputs(spark, sf_dir)).select("doc_id", "text")


def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without artefacts of copying."""
    return inputs(spark, sf_dir).select("doc_id", texts.clean_artifacts(F.coalesce("text", F.lit(""))).alias("text"))


def fold_for_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without accents and case."""
    return inputs(spark, sf_dir).select("doc_id", texts.fold_for_matching(F.coalesce("text", F.lit(""))).alias("text"))


def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as keys."""
    return inputs(spark, sf_dir).select("doc_id", texts.norm_key(F.coalesce("text", F.lit(""))).alias("text"))


def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts are the ambiguous word alone, or hold words that no establishment's name has."""
    t = F.coalesce("text", F.lit(""))
    return inputs(spark, sf_dir).select("doc_id", classify.is_habitat_alone(t).alias("habitat_alone"), classify.has_etab_exclude_token(t).alias("etab_excluded"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the normalized texts."""
    done = ENGINE.normalized(inputs(spark, sf_dir)).select("doc_id", F.posexplode(ner.chunks(F.col("text"))).alias("chunk", "c"))
    return done.select("doc_id", "chunk", F.col("c.start").alias("start_pos"), F.col("c.end").alias("end_pos"), F.md5("c.text").alias("digest"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the normalized texts."""
    done = ENGINE.normalized(inputs(spark, sf_dir)).select("doc_id", F.explode(ner.sentences(F.col("text"))).alias("c"))
    return done.select("doc_id", F.col("c.start").alias("start_pos"), F.col("c.end").alias("end_pos"), F.md5("c.text").alias("digest"))


def model_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model in Python workers finds in the chunks of the normalized texts, at the documents' places."""
    backend = ner.model_backend(fixtures.leading_word)
    done = ENGINE.normalized(inputs(spark, sf_dir)).select("doc_id", F.explode(backend(F.col("text"))).alias("a"))
    return done.select("doc_id", F.col("a.start").alias("start_pos"), F.col("a.end").alias("end_pos"), "a.label")


# --- candidates ---------------------------------------------------------------------------------------------------


def _rules(label: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: listed(ENGINE.candidates(inputs(spark, sf_dir)), (F.col("source") == "RULES") & (F.col("label") == label))


def rules_geo_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule matches that a following place extended, and whether their text still is the slice."""
    docs, text = Engine._once(ENGINE.normalized(inputs(spark, sf_dir))), F.col("text")
    bare = [catalog.Rule(r.seq, r.family, r.label, r.category, r.pattern, r.ignore_case, False, r.anchors) for r in ENGINE.rules() if r.extend_geo]
    found = let(hits(text, detect.anchors_of_all(bare, {})), lambda held: detect.rule_entities(text, held, bare))
    both = F.transform(found, lambda e: F.struct(e["end"].alias("end"), detect.extended(text, e).alias("x")))
    long = docs.select("doc_id", "text", F.explode(F.filter(both, lambda b: b["x"]["end"] > b["end"])).alias("b")).select("doc_id", "text", "b.x")
    whole = F.substring(F.col("text"), F.col("x.start") + 1, F.col("x.end") - F.col("x.start")) == F.col("x.text")
    return long.select("doc_id", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), F.col("x.text").alias("entity"), F.col("x.category").alias("category"), whole.alias("is_slice"))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates in order."""
    return listed(ENGINE.candidates(inputs(spark, sf_dir)), None, F.col("seq"))


def gazetteer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer matches as gazetteers of any size find them: names joined with the texts' words."""
    engine = replace(ENGINE, gazetteers=readers.gazetteer_table(spark, lexicon.GAZETTEERS))
    return listed(engine.candidates(inputs(spark, sf_dir)), F.col("source") == "GAZETTEER")


def person_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether named entities have the form of a person's name, and a person's surroundings."""
    docs = ENGINE.candidates(inputs(spark, sf_dir)).select("doc_id", "text", F.explode("entities").alias("e")).where("e.source = 'NER'")
    context = classify.has_person_context(classify._around(F.col("text"), F.col("e"), 50), F.col("e.text"))
    return docs.select("doc_id", F.col("e.seq").alias("seq"), F.col("e.text").alias("entity"), classify.is_person_name(F.col("e.text")).alias("person_form"), context.alias("person_context"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities each stage left, as the stages of one run observed them."""
    return ENGINE.counted(inputs(spark, sf_dir))


def _kept(keep: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listed(ENGINE.step(ENGINE.candidates(inputs(spark, sf_dir)), lambda t, entities: F.filter(entities, lambda e: keep(t, e))))

    return run


# --- classification -----------------------------------------------------------------------------------------------


def _reclassified(condition: Column) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = ENGINE.step(ENGINE.filtered(inputs(spark, sf_dir)), lambda t, entities: F.transform(entities, lambda e: classify.reclassified(t, e)))
        return listed(done, F.col("source").isin("ENHANCED", "NER_ENHANCED") & condition)

    return run


def _conditions() -> dict[str, Column]:
    label, source = F.col("label"), F.col("source")
    return {
        "reclass_chu": label == "ORG_CHU_CH",
        "reclass_address": label.startswith("ADDR_"),
        "reclass_city": label == "LOC_CITY",
        "reclass_type_prefix": source == "NER_ENHANCED",
        "reclass_context": label.startswith("ETAB_") & (source == "ENHANCED"),
        "reclass_person": label == "PER",
    }


def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities after reclassification and disambiguation."""
    return listed(ENGINE.classified(inputs(spark, sf_dir)))


# --- fusion and resolution ----------------------------------------------------------------------------------------


def fuse_type_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Establishment types fused with names."""
    return listed(ENGINE.fused(inputs(spark, sf_dir)), F.col("source") == "MERGED_TYPE_LOC", F.col("score"))


def _dropped(categories: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """Entities of the categories before fusion, and how many of their documents' entities are left after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = ENGINE.classified(inputs(spark, sf_dir))
        both = ENGINE.step(before, lambda t, e: e).withColumn("left", F.size(resolve.fused(F.col("text"), F.col("entities"))).cast("long"))
        gone = both.select("doc_id", "left", F.size(F.filter("entities", lambda e: (e["source"] == "RULES") & F.coalesce(e["category"].isin(categories), F.lit(False)))).cast("long").alias("matched"))
        return gone.where("matched > 0")

    return run


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fused entities that overlap, with their overlap ratios."""
    docs = ENGINE.fused(inputs(spark, sf_dir))
    one = F.transform("entities", lambda a: F.transform("entities", lambda b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["seq"] < b["seq"])), F.struct(a["seq"].alias("seq_a"), b["seq"].alias("seq_b"), resolve.overlap(a, b).alias("ratio")))))
    pairs = docs.select("doc_id", F.explode(F.flatten(one)).alias("p")).where("p is not null and p.ratio > 0")
    return pairs.select("doc_id", "p.seq_a", "p.seq_b", F.round("p.ratio", 9).alias("ratio"))


def entity_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused entities with their priorities."""
    docs = ENGINE.fused(inputs(spark, sf_dir)).select("doc_id", F.explode("entities").alias("e"))
    return docs.select("doc_id", F.col("e.seq").alias("seq"), resolve.priority_key(F.col("e")).alias("priority_key"), resolve.priority(F.col("e")).alias("priority"))


def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are left without conflicts."""
    return listed(ENGINE.resolved(inputs(spark, sf_dir)))


def entities_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities are left under each priority key."""
    docs = ENGINE.resolved(inputs(spark, sf_dir)).select(F.explode("entities").alias("e"))
    return docs.groupBy(resolve.priority_key(F.col("e")).alias("priority_key")).agg(F.count("*").alias("n"))


# --- rewriting ----------------------------------------------------------------------------------------------------


def pseudonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymized texts."""
    return ENGINE.pseudonymized(inputs(spark, sf_dir)).select("doc_id", F.col("output").alias("text"), F.size("entities").cast("long").alias("n_applied"))


def _aliases(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("aliases").alias("a")).select("doc_id", "a.original", "a.alias", "a.prefix", "a.n")


def alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases of each document."""
    return _aliases(ENGINE.pseudonymized(inputs(spark, sf_dir)))


def alias_mapping_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New aliases of each document beside those of an earlier run, and the texts' digests."""
    known = F.create_map(*(F.lit(x) for o, a, _, _ in fixtures.KNOWN for x in (o, a)))
    base = F.create_map(*(F.lit(x).cast(t) for _, _, p, n in fixtures.KNOWN for x, t in ((p, "string"), (n, "bigint"))))
    done = ENGINE.pseudonymized(inputs(spark, sf_dir), known, base)
    return done.select("doc_id", F.md5("output").alias("digest"), F.explode_outer("aliases").alias("a")).select("doc_id", "digest", F.coalesce("a.original", F.lit("")).alias("original"), F.coalesce("a.alias", F.lit("")).alias("alias"), F.coalesce("a.n", F.lit(0)).cast("bigint").alias("n"))


def depseudonymize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored texts, and whether they are the normalized ones."""
    done = ENGINE.pseudonymized(inputs(spark, sf_dir)).select("doc_id", "text", rewrite.restored(F.col("output"), F.col("aliases")).alias("restored"))
    return done.select("doc_id", F.col("restored").alias("text"), (F.col("restored") == F.col("text")).alias("is_whole"))


def pseudonymize_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an alias for each named entity's occurrence."""
    return ENGINE.by_occurrence(inputs(spark, sf_dir)).select("doc_id", F.col("output").alias("text"))


def corpus_alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alias numbering for all documents: originals and prefixes, and the number of aliases of each prefix."""
    done = ENGINE.pseudonymized(inputs(spark, sf_dir)).select("doc_id", F.explode("entities").alias("e"))
    flat = done.select("doc_id", F.col("e.start").alias("start"), F.col("e.text").alias("text"), F.coalesce("e.category", "e.label").alias("prefix"))
    return rewrite.corpus_aliases(flat).groupBy("prefix").agg(F.count("*").alias("n_originals"), F.count_distinct("alias").alias("n_aliases"), F.max("n").alias("highest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable of (spark, sf_dir)."""
    named = [scan_documents, gazetteer_entries, rule_catalog, mapping_load, mapping_stats, normalize_text, clean_artifacts, fold_for_matching, norm_key, text_predicates, chunk_documents]
    named += [restore_loaded, docx_scan, text_sink, sentence_chunks, model_annotations, gazetteer_join, person_predicates, stage_counts]
    named += [rules_geo_extended, candidate_union, disambiguate, fuse_type_name, overlap_pairs, entity_priority, resolve_conflicts, entities_by_key]
    named += [pseudonymize_documents, alias_mapping, alias_mapping_incremental, depseudonymize_roundtrip, pseudonymize_occurrence, corpus_alias_mapping]
    found = {f.__name__: f for f in named}
    found["ner_scan"] = lambda spark, sf_dir: listed(ENGINE.candidates(inputs(spark, sf_dir)), F.col("source") == "NER", F.col("score"))
    found |= {f"rules_{label.lower()}": _rules(label) for label in ("ORG", "ETAB", "DATE", "PHONE", "NIR", "TIME", "EMAIL")}
    found["gazetteer_scan"] = lambda spark, sf_dir: listed(ENGINE.candidates(inputs(spark, sf_dir)), F.col("source") == "GAZETTEER")
    found["filter_stopwords"] = _kept(classify.not_stopword)
    found["filter_exclusions"] = _kept(lambda t, e: classify.not_excluded(e, lexicon.EXCLUSIONS))
    found["filter_validity"] = _kept(lambda t, e: classify.valid(e))
    for name in ("reclass_chu", "reclass_address", "reclass_city", "reclass_type_prefix", "reclass_context", "reclass_person"):
        found[name] = lambda spark, sf_dir, name=name: _reclassified(_conditions()[name])(spark, sf_dir)
    found["drop_lone_types"] = _dropped(lexicon.FUSABLE)
    found["drop_services"] = _dropped(lexicon.SERVICES)
    return found


def oracle_sql() -> dict[str, str]:
    """Query name to the DuckDB SQL that gives the same rows."""
    o, q, base = oracle, oracle.query, oracle.COLUMNS
    plain = [o.DOCS]
    out = {
        "scan_documents": "SELECT doc_id, text, length(text) AS n_code_points FROM documents",
        "gazetteer_entries": f"SELECT * FROM ({o.values([(g, n, c) for g, e in lexicon.GAZETTEERS.items() for n, c in e] + fixtures.CSV_ENTRIES)}) g(gazetteer, name, category)",
        "rule_catalog": f"SELECT * FROM ({o.values(fixtures.RULES)}) r(family, n_categories, n_patterns)",
        "mapping_load": f"SELECT original, alias, prefix, n FROM ({o.values(fixtures.JSON_ENTRIES)}) k(original, alias, prefix, n)",
        "restore_loaded": q([o.DOCS, o.NORMALIZED], "SELECT doc_id, t || ' 115, CAF de Paris <PHONE_70> café \"x\"' AS text FROM norm"),
        "docx_scan": f"SELECT * FROM ({o.values(fixtures.DOCX_TEXTS)}) d(file, text)",
        "text_sink": q([o.DOCS, o.NORMALIZED], "SELECT doc_id, t AS text FROM norm"),
        "sentence_chunks": o.sentenced(),
        "model_annotations": o.modelled(),
        "gazetteer_join": q(o.DETECT, f"SELECT {base} FROM cand WHERE source = 'GAZETTEER'"),
        "person_predicates": o.persons(),
        "stage_counts": o.counted(),
        "mapping_stats": q(o.REWRITE, "SELECT prefix, count(*) AS total, max(n) AS highest FROM alia GROUP BY prefix"),
        "normalize_text": q([o.DOCS, o.NORMALIZED], "SELECT doc_id, t AS text FROM norm"),
        "clean_artifacts": q(plain, r"SELECT doc_id, replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), chr(9), ' ') AS text FROM docs"),
        "fold_for_matching": q(plain, "SELECT doc_id, lower(strip_accents(coalesce(text, ''))) AS text FROM docs"),
        "norm_key": q(plain, r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\pZ\x0B\x{85}]+', ' ', 'g')) AS text FROM docs"),
        "text_predicates": q(plain, f"SELECT doc_id, lower(trim(coalesce(text, ''))) = 'habitat' AS habitat_alone, {o.any_of('lower(coalesce(text, chr(32)))', lexicon.ETAB_TOKENS)} AS etab_excluded FROM docs"),
        "chunk_documents": o.chunked(),
        "candidate_union": q(o.DETECT, f"SELECT {base}, seq FROM cand"),
        "rules_geo_extended": q(o.DETECT, "SELECT r.doc_id, b AS start_pos, e AS end_pos, x AS entity, category, substr(n.t, b + 1, e - b) = x AS is_slice FROM ruled r JOIN norm n USING (doc_id) WHERE p <> ''"),
        "ner_scan": q(o.DETECT, f"SELECT {base}, score FROM cand WHERE source = 'NER'"),
        "gazetteer_scan": q(o.DETECT, f"SELECT {base} FROM cand WHERE source = 'GAZETTEER'"),
        "filter_stopwords": q(o.DETECT, f"SELECT {base} FROM cand JOIN norm USING (doc_id) WHERE {o.STOP}"),
        "filter_exclusions": q(o.DETECT, f"SELECT {base} FROM cand WHERE {o.KEPT}"),
        "filter_validity": q(o.DETECT, f"SELECT {base} FROM cand WHERE {o.VALID}"),
        "disambiguate": q(o.CLASSIFY, f"SELECT {base} FROM disa"),
        "fuse_type_name": q(o.RESOLVE, f"SELECT {base}, score FROM fuse WHERE source = 'MERGED_TYPE_LOC'"),
        "overlap_pairs": q(
            o.RESOLVE,
            "SELECT doc_id, seq_a, seq_b, round(ratio, 9) AS ratio FROM (SELECT x.doc_id, x.seq AS seq_a, y.seq AS seq_b, greatest(least(x.e, y.e) - greatest(x.b, y.b), 0) / least(x.e - x.b, y.e - y.b) AS ratio FROM fuse x JOIN fuse y ON x.doc_id = y.doc_id AND (x.b < y.b OR x.b = y.b AND x.seq < y.seq)) WHERE ratio > 0",
        ),
        "entity_priority": q(o.RESOLVE, "SELECT doc_id, seq, pkey AS priority_key, pri AS priority FROM fuse"),
        "resolve_conflicts": q(o.RESOLVE, f"SELECT {base} FROM reso"),
        "entities_by_key": q(o.RESOLVE, "SELECT pkey AS priority_key, count(*) AS n FROM reso GROUP BY pkey"),
        "pseudonymize_documents": q(o.REWRITE, "SELECT doc_id, o AS text, coalesce(n, 0) AS n_applied FROM outp LEFT JOIN (SELECT doc_id, count(*) AS n FROM done GROUP BY doc_id) USING (doc_id)"),
        "alias_mapping": q(o.REWRITE, "SELECT doc_id, original, '<' || prefix || '_' || n || '>' AS alias, prefix, n FROM alia"),
        "alias_mapping_incremental": q([*o.RESOLVE, *o.rewriting(True)], "SELECT doc_id, md5(o) AS digest, coalesce(original, '') AS original, coalesce('<' || prefix || '_' || n || '>', '') AS alias, coalesce(n, 0) AS n FROM outp LEFT JOIN alia USING (doc_id)"),
        "depseudonymize_roundtrip": q([o.DOCS, o.NORMALIZED], "SELECT doc_id, t AS text, true AS is_whole FROM norm"),
        "pseudonymize_occurrence": q(
            [*o.DETECT, "only_ner AS (SELECT c.*, t FROM cand c JOIN norm USING (doc_id) WHERE source = 'NER')", *o._rewriting("only_ner", "label", False, False)], "SELECT doc_id, o AS text FROM outp"
        ),
        "corpus_alias_mapping": q(
            o.REWRITE, "SELECT prefix, count(*) AS n_originals, count(*) AS n_aliases, count(*) AS highest FROM (SELECT x, prefix FROM done QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, b DESC, prefix) = 1) GROUP BY prefix"
        ),
    }
    out |= {f"rules_{label.lower()}": q(o.DETECT, f"SELECT {base} FROM cand WHERE source = 'RULES' AND label = '{label}'") for label in ("ORG", "ETAB", "DATE", "PHONE", "NIR", "TIME", "EMAIL")}
    cases = {
        "reclass_chu": "label = 'ORG_CHU_CH'",
        "reclass_address": "label LIKE 'ADDR_%'",
        "reclass_city": "label = 'LOC_CITY'",
        "reclass_type_prefix": "source = 'NER_ENHANCED'",
        "reclass_context": "label LIKE 'ETAB_%' AND source = 'ENHANCED'",
        "reclass_person": "label = 'PER'",
    }
    out |= {name: q(o.CLASSIFY, f"SELECT {base} FROM recl WHERE source IN ('ENHANCED', 'NER_ENHANCED') AND {c}") for name, c in cases.items()}
    for name, kinds in (("drop_lone_types", lexicon.FUSABLE), ("drop_services", lexicon.SERVICES)):
        out[name] = q(
            o.RESOLVE,
            f"SELECT doc_id, matched, coalesce(n, 0) AS \"left\" FROM (SELECT doc_id, count(*) AS matched FROM disa WHERE source = 'RULES' AND category IN {o.strings(kinds)} GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM fuse GROUP BY doc_id) USING (doc_id)",
        )
    return out
