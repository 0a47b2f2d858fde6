"""The pseudonymization plan of a table of documents: one scan, no shuffle of texts, entities as arrays."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.spans import hits
from ..functions.text import normalize
from ..operators import classify, detect, ner, resolve, rewrite
from ..operators.entities import let, none
from ..sources import catalog, lexicon, readers


@dataclass
class Engine:
    """What a run detects with.

    ``profile`` is "faithful" or "repaired" (see the catalog); ``extra`` are further rules by family and category, and
    the only ones without ``shipped``; ``gazetteers`` are names and categories by gazetteer, or a table (gazetteer, name,
    category) of any size; ``backend`` gives annotations of a text column, beside those of the input's column ``ner``
    (``ner.heuristic``, or ``ner.model_backend`` with a model). Where ``watch`` is a dict, it takes an ``Observation`` of each
    step's number of entities, which the next action on the plan fills.
    """

    profile: str = "faithful"
    extra: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    shipped: bool = True
    gazetteers: dict[str, list[tuple[str, str]]] | DataFrame = field(default_factory=lambda: lexicon.GAZETTEERS)
    exclusions: list[str] = field(default_factory=lambda: lexicon.EXCLUSIONS)
    backend: object = staticmethod(ner.heuristic)
    watch: dict[str, Observation] | None = None

    def normalized(self, docs: DataFrame) -> DataFrame:
        """doc_id, ner and the normalized text."""
        own = F.col("ner") if "ner" in docs.columns else F.array().cast(ner.ANNOTATIONS)
        return docs.select("doc_id", own.alias("ner"), normalize(F.coalesce("text", F.lit(""))).alias("text"))

    def rules(self) -> list[catalog.Rule]:
        """The rules of the profile."""
        return catalog.rules(self.profile, self.extra, self.shipped)

    def _annotated(self, docs: DataFrame) -> DataFrame:
        """doc_id, normalized text and in ``ner`` the input's annotations, then the backend's."""
        done = self._once(self.normalized(docs))
        return done.withColumn("ner", F.concat("ner", self.backend(F.col("text")))) if self.backend else done

    def _stage(self, docs: DataFrame, build) -> DataFrame:
        return self._annotated(docs).withColumn("entities", build(F.col("text"), F.col("ner"))).select("doc_id", "text", "entities")

    @staticmethod
    def _once(docs: DataFrame) -> DataFrame:
        """Bars the optimizer from inlining the normalized text into each of its uses: exploding an array of one row stops it."""
        one = F.explode(F.array(F.struct("doc_id", "ner", "text"))).alias("d")
        return docs.select(one).select("d.*")

    def _watched(self, docs: DataFrame, stage: str) -> DataFrame:
        if self.watch is None:
            return docs
        self.watch[stage] = Observation()
        return docs.observe(self.watch[stage], F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"))

    def candidates(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, entities: all candidates."""
        rules = self.rules()
        if isinstance(self.gazetteers, DataFrame) or detect.size_of(self.gazetteers) > detect.LITERAL_ENTRIES:
            return self._watched(self._joined(docs, rules), "candidates")
        anchors = detect.anchors_of_all(rules, self.gazetteers)

        def found(t: Column, n: Column) -> Column:
            return let(hits(t, anchors), lambda held: detect.candidates(detect.ner_entities(t, n), detect.rule_entities(t, held, rules), detect.gazetteer_entities(t, held, self.gazetteers)))

        return self._watched(self._stage(docs, found), "candidates")

    def _joined(self, docs: DataFrame, rules: list[catalog.Rule]) -> DataFrame:
        table = self.gazetteers if isinstance(self.gazetteers, DataFrame) else readers.gazetteer_table(docs.sparkSession, self.gazetteers)
        named = detect.joined_entities(self._annotated(docs), table)
        text, anchors = F.col("text"), detect.anchors_of_all(rules, {})
        found = let(hits(text, anchors), lambda held: detect.candidates(detect.ner_entities(text, F.col("ner")), detect.rule_entities(text, held, rules), F.col("names")))
        return self.step(named.withColumn("entities", F.lit(0)), lambda t, e: found)

    def step(self, docs: DataFrame, change, stage: str | None = None) -> DataFrame:
        """The documents with ``entities`` changed by a function of text and entities, computed once."""
        one = F.explode(F.array(F.struct("doc_id", "text", change(F.col("text"), F.col("entities")).alias("entities")))).alias("d")
        done = docs.select(one).select("d.*")
        return self._watched(done, stage) if stage else done

    def filtered(self, docs: DataFrame) -> DataFrame:
        """After stop words, exclusions and validity."""
        return self.step(self.candidates(docs), lambda t, e: classify.filtered(t, e, self.exclusions), "filtered")

    def classified(self, docs: DataFrame) -> DataFrame:
        """After reclassification and disambiguation."""
        return self.step(self.filtered(docs), classify.classified, "classified")

    def fused(self, docs: DataFrame) -> DataFrame:
        """After fusion; lone types and services are gone."""
        return self.step(self.classified(docs), resolve.fused, "fused")

    def resolved(self, docs: DataFrame) -> DataFrame:
        """Without conflicts."""
        return self.step(self.fused(docs), lambda t, e: resolve.resolved(e), "resolved")

    def applied(self, docs: DataFrame) -> DataFrame:
        """Those that are rewritten, rightmost first; the others' texts aren't the slices at their places."""
        return self.step(self.resolved(docs), rewrite.applied, "applied")

    def counted(self, docs: DataFrame) -> DataFrame:
        """(stage, entities): how many entities of all documents each stage left, from one run over them.

        ``skipped`` are those resolved but not rewritten.
        """
        stages: dict[str, Observation] = {}
        replace(self, watch=stages).applied(docs).write.format("noop").mode("overwrite").save()
        found = {stage: int(o.get["entities"]) for stage, o in stages.items()}
        found["skipped"] = found["resolved"] - found["applied"]
        return docs.sparkSession.createDataFrame(list(found.items()), "stage string, entities long")

    def pseudonymized(self, docs: DataFrame, known: Column | None = None, base: Column | None = None) -> DataFrame:
        """doc_id, text (normalized), entities (applied, rightmost first), aliases (new ones) and output."""
        done = self.applied(docs)
        one = F.explode(F.array(F.struct("doc_id", "text", "entities", rewrite.aliases(F.col("entities"), known, base).alias("aliases")))).alias("d")
        out = rewrite.pseudonymized(F.col("text"), F.col("entities"), F.col("aliases"), known)
        return done.select(one).select("d.*").withColumn("output", out)

    def by_occurrence(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, output, aliases: every NER entity an alias of its own, without rules or conflicts resolved."""
        only = self._stage(docs, lambda t, n: resolve.numbered(detect.ner_entities(t, n)))
        done = self.step(only, rewrite.applied)
        one = F.explode(F.array(F.struct("doc_id", "text", "entities", rewrite.occurrence_aliases(F.col("entities")).alias("aliases")))).alias("d")
        pairs = F.zip_with("entities", "aliases", lambda e, a: F.struct(e["start"].alias("start"), e["end"].alias("end"), a["alias"].alias("alias")))
        return done.select(one).select("d.*").withColumn("output", rewrite.rewritten(F.col("text"), pairs))


def empty() -> Column:
    """No entities."""
    return none()
