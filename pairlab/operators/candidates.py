"""Constrained candidates: metadata, the universe of passages, eligibility, and the choice of one.

A candidate is a distinct (document, normalized passage). It is eligible for a query if they share a
code, it was published strictly before the query's date, the query or its application neither
cites nor references its document, and document, passage and component differ from the query's own.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hashing as H
from ..functions.collections import parse_codes, parse_references
from ..functions.dates import choose_date, parse_date
from ..functions.text import base_id, component, normalize_id, normalize_text
from ..plans.cut import cut
from ..plans.sequence import running
from . import eligible
from .joins import last_values
from .schema import resolved

_META = ("input_id", "base_id", "row_pos")
#: Kinds of properties of a candidate: its codes are wanted, the others may be barred.
_CODE, _DOCUMENT, _PASSAGE, _COMPONENT = range(4)

#: The reasons for an empty pool, in the order in which they apply, and the names of the rules checked.
REASONS = ("missing_target_metadata", "missing_target_cpc", "missing_target_date", "no_remaining_candidate")
CHECKS = ("duplicate_queries", "duplicate_query_passage_pairs", "same_as_hard_u_passage", "same_as_hard_u_document", "existing_citation_or_reference", "time_violation", "cpc_violation", "same_component_violation")


def metadata(meta: DataFrame) -> DataFrame:
    """``base``, ``pub``, ``codes``, ``refs`` of each document; the last of its rows counts."""
    base = F.coalesce(F.when(base_id("base_id") != "", base_id("base_id")), base_id("input_id"))
    rows = meta.select(base.alias("base"), parse_date("publication_date").alias("pub"), parse_codes("cpc_subclasses").alias("codes"), parse_references("reference_bases").alias("refs"), "row_pos")
    return last_values(rows.where("base <> ''"), ["base"], ["pub", "codes", "refs"], "row_pos")


def prepared(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """The pairs, of one or several splits (``split``), with resolved application and document and digests of the normalized texts.

    ``hard_doc`` is the document of an uncited row (its candidate's, else the cited one), ``doc`` that of any other. No text moves."""
    day, source = choose_date(["_date", "_parsed_date", "date"])
    comp = F.coalesce(component("_u_target_component"), component("_priority_component_id"))
    uncited = F.coalesce(F.col("label") == 2, F.lit(False))
    of = F.when(uncited, F.coalesce("_u_candidate_base", "cited_document_id")).otherwise(F.col("cited_document_id"))
    p = pairs.select("split", "_row_id", "claim_id", "label", normalize_id("patent_application_id").alias("__a"), normalize_id(of).alias("__d"), F.md5(normalize_text("text")).alias("q"), F.md5(normalize_text("text_b")).alias("passage"), day.alias("target"), source.alias("target_source"), comp.alias("target_component"), component("_priority_component_id").alias("own_component"))
    ids = cut(resolved(p.select(F.explode(F.array("__a", "__d")).alias("exact")).distinct(), meta, *_META))
    for k, name in (("__a", "app"), ("__d", "__doc")):
        p = p.join(ids.select(F.col("exact").alias(k), F.col("target").alias(name)), k, "left").drop(k)
    return p.withColumn("doc", F.when(~uncited, F.col("__doc"))).withColumn("hard_doc", F.when(uncited, F.col("__doc"))).drop("__doc")


def universe(prep: DataFrame, docs: DataFrame) -> DataFrame:
    """``split``, ``cand``, ``base``, ``text_key``, ``pub``, ``codes``, ``components``: each split's distinct cited passages with a date and codes.

    ``text_key`` is the passage's digest. ``cand`` numbers them within the split by first appearance (row id, then document and digest)."""
    rows = prep.where((F.col("label") != 2) & (F.col("doc") != "") & (F.col("passage") != F.md5(F.lit(""))))
    found = rows.groupBy("split", F.col("doc").alias("base"), F.col("passage").alias("text_key")).agg(F.min("_row_id").alias("first"), F.array_sort(F.collect_set("own_component")).alias("components"))
    dated = found.join(docs.where("pub is not null and size(codes) > 0").select("base", "pub", "codes"), "base")
    return running(dated, ["split"], ["first", "base", "text_key"], {"cand": None}).select("split", "cand", "base", "text_key", "pub", "codes", "components")


def targets(prep: DataFrame, docs: DataFrame) -> DataFrame:
    """The uncited rows, one for each split and claim, with their application's codes and references."""
    one = prep.where("label = 2").groupBy("split", "claim_id").agg(F.min(F.struct("_row_id", "app", "hard_doc", "q", "passage", "target", "target_source", "target_component")).alias("v")).select("split", "claim_id", "v.*")
    own = docs.select(F.col("base").alias("app"), F.col("codes").alias("target_codes"), F.col("refs").alias("target_refs"), F.lit(True).alias("known"))
    return one.join(own, "app", "left")


def draws(target: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """``split``, ``claim_id``, ``draw``: a digest of seed, split, application and text for each target. Only texts of uncited rows move, once."""
    key = ["split", "claim_id", "q"]
    texts = pairs.where("label = 2").select("split", "claim_id", normalize_text("text").alias("__q")).groupBy("split", "claim_id", F.md5("__q").alias("q")).agg(F.min("__q").alias("__q"))
    return target.select(*key, "app").join(texts, key).select("split", "claim_id", F.sha2(F.concat_ws("|", F.lit(str(seed)), "split", "app", "__q"), 256).alias("draw"))


def _usable(target: DataFrame) -> DataFrame:
    return target.where("known and size(target_codes) > 0 and target is not null")


def barred(target: DataFrame, prep: DataFrame) -> DataFrame:
    """``split``, ``claim_id``, ``kind``, ``value``: what a target's candidates may not have. The document is the target's application, its
    uncited document, a reference, or cited by the claim's text or its application; the passage is the target's or in a row of
    its claim; the component is the target's."""
    t, cited = _usable(target), prep.where("label <> 2")
    key = ["split", "claim_id"]
    told = lambda df, kind, c: df.select(*key, F.lit(kind).alias("kind"), c.alias("value")).where("value is not null")
    docs = cited.select("split", "app", "q", F.col("doc").alias("base"))
    own = F.explode(F.array_union(F.array("app", "hard_doc"), F.coalesce("target_refs", F.array().cast("array<string>"))))
    by_app = t.select(*key, "app").join(docs.select("split", "app", "base").distinct(), ["split", "app"])
    by_query = t.select(*key, "q").join(docs.select("split", "q", "base").distinct(), ["split", "q"])
    passages = t.select(*key, "q").join(prep.select("split", "q", F.col("passage").alias("key")).distinct(), ["split", "q"])
    found = told(t, _DOCUMENT, own).union(told(by_app, _DOCUMENT, F.col("base"))).union(told(by_query, _DOCUMENT, F.col("base")))
    return found.union(told(t, _PASSAGE, F.col("passage"))).union(told(passages, _PASSAGE, F.col("key"))).union(told(t, _COMPONENT, F.col("target_component")))


def failures(target: DataFrame, sizes: DataFrame) -> DataFrame:
    """``split``, ``claim_id``, ``reason``: why a target has no pool, the first that applies; null where it has one."""
    some = sizes.select("split", "claim_id", F.lit(True).alias("has"))
    empty = (F.col("known").isNull(), F.size("target_codes") == 0, F.col("target").isNull(), F.col("has").isNull())
    reason = F.coalesce(*[F.when(c, name) for c, name in zip(empty, REASONS)])
    return target.join(some, ["split", "claim_id"], "left").select("split", "claim_id", reason.alias("reason"))


def choose(asked: DataFrame, index: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """``split``, ``claim_id``, ``cand``, ``pool_size``: one eligible candidate for each target, its place in the pool (by number) taken from its ``draw``.

    The counts by block tell in which block the place is; only that block is looked at."""
    key = ["split", "claim_id"]
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).withColumn("pool_size", F.sum("n").over(W.partitionBy(*key)))
    drawn = asked.join(placed, key).withColumn("at", H.drawn("pool_size", F.col("draw"))).where("before <= at and at < before + n").withColumn("k", F.col("at") - F.col("before"))
    drawn = cut(eligible.ordered(drawn))
    return eligible.picked(drawn, index, size).join(drawn.select(*key, "pool_size"), key)


def random_candidates(target: DataFrame, cands: DataFrame, chosen: DataFrame, passages: DataFrame, seed: int) -> DataFrame:
    """The chosen candidates as rows like the uncited ones, with their pool size and the source of the date. ``passages``: ``split``, ``passage``."""
    picked = cut(chosen.join(cands, ["split", "cand"]).join(target.drop("pub"), ["split", "claim_id"]))
    texts = passages.select("split", F.md5("passage").alias("text_key"), "passage").join(picked.select("split", "text_key").distinct(), ["split", "text_key"]).groupBy("split", "text_key").agg(F.min("passage").alias("cpassage"))
    picked = picked.join(texts, ["split", "text_key"])
    return picked.select("split", F.concat(F.lit("random_"), "split", F.lit("_"), "_row_id").alias("row_id"), "claim_id", F.col("base").alias("candidate_base"), F.date_format("pub", "yyyy-MM-dd").alias("candidate_date"), F.array_join("codes", "|").alias("candidate_codes"), F.col("cpassage").alias("text_b"), F.lit(2).alias("label"), F.lit(seed).alias("seed"), "pool_size", "target_source")


def violations(random: DataFrame, target: DataFrame, prep: DataFrame, docs: DataFrame) -> DataFrame:
    """``split``, ``check``, ``count``: eight rules, derived again from output rows (``split``, ``claim_id``, ``candidate_base`` and ``text_b``
    or its digest ``text_key``). With a column ``source`` they are counted for each, in the same joins.

    Whatever a join decides is told at once: lists of codes and references don't move on to the next."""
    key = F.col("text_key") if "text_key" in random.columns else F.md5("text_b")
    by = [c for c in ("source", "split") if c in random.columns]
    yes = lambda c: F.coalesce(c, F.lit(False))
    t = target.select("split", "claim_id", "app", "hard_doc", "q", "passage", "target", "target_codes", "target_refs", "target_component")
    d = docs.select(F.col("base").alias("candidate_base"), "pub", "codes")
    cited = prep.where("label <> 2").select("split", "claim_id", "app", F.col("doc").alias("candidate_base"), F.col("passage").alias("key"), "own_component")
    comps = cited.groupBy("split", "candidate_base", "key").agg(F.collect_set("own_component").alias("components"))
    by_claim = cited.select("split", "claim_id", "candidate_base", F.lit(True).alias("cited")).distinct()
    by_app = cited.select("split", "app", "candidate_base", F.lit(True).alias("cited_app")).distinct()
    rows = [*by, "claim_id", "app", "candidate_base", "q", "key"]
    r = random.select(*by, "claim_id", "candidate_base", key.alias("key")).join(t, ["split", "claim_id"])
    same = (F.col("key") == F.col("passage")).alias("same_passage"), (F.col("candidate_base") == F.col("hard_doc")).alias("same_document"), yes(F.array_contains("target_refs", F.col("candidate_base"))).alias("referenced")
    r = r.select(*rows, *same, "target", "target_codes", "target_component").join(d, "candidate_base", "left")
    told = ["same_passage", "same_document", "referenced"]
    r = r.select(*rows, *told, (~yes(F.col("pub") < F.col("target"))).alias("late"), (~yes(F.arrays_overlap("codes", "target_codes"))).alias("no_code"), "target_component").join(comps, ["split", "candidate_base", "key"], "left")
    told += ["late", "no_code"]
    r = r.select(*rows, *told, yes(F.array_contains("components", F.col("target_component"))).alias("same_component"))
    r = r.join(by_claim, ["split", "claim_id", "candidate_base"], "left").join(by_app, ["split", "app", "candidate_base"], "left")
    counts = (
        F.count("*") - F.countDistinct("q"),
        F.count("*") - F.countDistinct("q", "key"),
        F.count_if("same_passage"),
        F.count_if("same_document"),
        F.count_if(yes(F.col("cited")) | yes(F.col("cited_app")) | F.col("referenced")),
        F.count_if("late"),
        F.count_if("no_code"),
        F.count_if("same_component"),
    )
    agg = r.groupBy(*by).agg(*[c.alias(n) for n, c in zip(CHECKS, counts)])
    return agg.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("count")) for c in CHECKS])).alias("x")).select(*by, "x.check", "x.count")


def pool_summary(target: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each split: targets with a pool, coverage, and mean, median, least and largest pool."""
    both = target.join(sizes, ["split", "claim_id"], "left").groupBy("split")
    return both.agg(F.count("n").alias("queries"), F.round(F.count("n") / F.count("*"), 6).alias("coverage"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def near_ties(best: DataFrame, max_rank: int = 3, max_gap: float = 0.002, digits: int = 6) -> DataFrame:
    """``key``, ``rank``, ``gap``, ``near_tie`` of each target's own candidate among its scored ones (``eligible.best`` with ``own``)."""
    rank, gap = F.col("above") + 1, F.round(F.col("score") - F.col("own"), digits)
    told = best.where("own is not null").select(F.concat_ws("|", "split", "claim_id").alias("key"), rank.alias("rank"), gap.alias("gap"))
    return told.withColumn("near_tie", (F.col("rank") <= max_rank) & (F.col("gap") <= max_gap))


class Chain:
    """The stages over the rows of several splits (``split``); what several stages use is written once, when first asked for. No pool is."""

    def __init__(self, pairs: DataFrame, meta: DataFrame, seed: int = 42, block: int = eligible.BLOCK):
        self.pairs, self.seed, self.block = pairs, seed, block
        self.prep, self.docs = cut(prepared(pairs, meta)), cut(metadata(meta))
        self.cands, self.targets = cut(universe(self.prep, self.docs)), cut(targets(self.prep, self.docs))

    @cached_property
    def _index(self) -> tuple[DataFrame, DataFrame]:
        return eligible.numbered(self.cands, [F.col("codes"), F.array("base"), F.array("text_key"), F.col("components")])

    def asked(self, target: DataFrame | None = None, *also: str) -> DataFrame:
        """The usable targets as ``eligible`` takes them, with other columns of theirs."""
        return eligible.asked(_usable(self.targets if target is None else target), "target_codes", _CODE, barred(self.targets, self.prep), self._index[1], *also)

    @cached_property
    def _asked(self) -> DataFrame:
        return self.asked()

    @property
    def index(self) -> DataFrame:
        return self._index[0]

    @cached_property
    def counts(self) -> DataFrame:
        return cut(eligible.counts(self._asked, self.index, self.block))

    @property
    def sizes(self) -> DataFrame:
        return self.counts.groupBy("split", "claim_id").agg(F.sum("n").alias("n"))

    def pool(self) -> DataFrame:
        """``split``, ``claim_id``, ``cand`` for every eligible candidate."""
        return eligible.pairs(self._asked, self.index, min(self.block, eligible.PAIR_BLOCK))

    @cached_property
    def chosen(self) -> DataFrame:
        drawn = self._asked.join(draws(self.targets, self.pairs, self.seed), ["split", "claim_id"])
        return cut(choose(drawn, self.index, self.counts, self.block))

    def picked(self) -> DataFrame:
        """``split``, ``claim_id``, ``candidate_base``, ``text_key`` of the chosen candidates."""
        return self.chosen.join(self.cands, ["split", "cand"]).select("split", "claim_id", F.col("base").alias("candidate_base"), "text_key")

    def random(self) -> DataFrame:
        return random_candidates(self.targets, self.cands, self.chosen, self.pairs.where("label <> 2").select("split", normalize_text("text_b").alias("passage")), self.seed)
