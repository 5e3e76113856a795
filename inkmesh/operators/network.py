"""Item networks: pairs, strengths, thresholds, selection and normalisation, over incidence (doc, key)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.operators import match, units
from inkmesh.operators.graph import largest_component
from inkmesh.plans.spec import MapSpec
from inkmesh.plans.staging import stage


def item_stats(inc: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, key), (doc, year, cites) -> key, occ, cites, avg_year (of known years, else null)."""
    year = F.when(F.col("year") != 0, F.col("year"))
    return inc.select("doc", "key").distinct().join(docs.select("doc", "year", "cites"), "doc").groupBy("key").agg(F.count(F.lit(1)).alias("occ"), F.sum("cites").cast("long").alias("cites"), F.avg(year).alias("avg_year"))


def hidden_singles(inc: DataFrame) -> DataFrame:
    """One row: keys in all, and keys of one document only."""
    n = inc.groupBy("key").agg(F.count_distinct("doc").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") < 2).alias("hidden_singles"))


def frequent(inc: DataFrame, least: int, exclusions: DataFrame | None = None) -> DataFrame:
    """The incidence of keys in `least` documents or more; aggregated first, so rare keys never reach a pair join."""
    keys = inc.groupBy("key").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= least).select("key")
    if exclusions is not None:
        keys = keys.join(exclusions.select("key"), "key", "left_anti")
    return inc.join(keys, "key", "left_semi")


def cooccurrence(inc: DataFrame, least: int = 1, fractional: bool = False, max_units: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """(doc, key) -> a < b, w: documents that hold both; fractional documents weigh 1 / (units - 1), units as before the threshold.

    Documents with over max_units units are left out (co-authorship). Thresholds apply before the pair join, and both
    sides are hashed by doc, so the join and the weights share one shuffle. among: pairs of these keys (key) alone.
    """
    each = inc.select("doc", "key").repartition("doc").distinct()
    if fractional or max_units:
        each = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
        if max_units:
            each = each.where(F.col("n") <= max_units)
    else:
        each = each.withColumn("n", F.lit(0).cast("long"))
    if among is not None:
        each = each.join(among.select("key"), "key", "left_semi")
    kept = frequent(each, least)
    one, two = kept.select("doc", F.col("key").alias("a"), "n"), kept.select("doc", F.col("key").alias("b"))
    w = 1.0 / (F.col("n") - 1) if fractional else F.lit(1.0)
    return one.join(two, "doc").where("a < b").groupBy("a", "b").agg(F.sum(w).alias("w"))


def coupling(cited: DataFrame, max_docs: int = 2000, fractional: bool = False) -> DataFrame:
    """(doc, ref) -> a < b, w: references that two documents share; fractional ones weigh 1 / (docs - 1).

    References of one document, or of over max_docs, couple nothing: the measure leaves out what everyone cites.

    A shuffle carries, for each document of a reference, the list of those behind it, not a row a pair; the lists of a
    document are then counted as they stream by, in order of document.
    """
    each = cited.select("doc", "ref").distinct()
    n = each.groupBy("ref").count().where(F.col("count").between(2, max_docs)).select("ref", "count")
    kind = each.schema["doc"].dataType.simpleString()
    lists = each.join(n, "ref").groupBy("ref").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    f = 1.0 / (F.size("docs") - 1) if fractional else F.lit(1.0)
    behind = lists.select(f.alias("f"), "docs", F.posexplode("docs").alias("at", "a")).where(F.col("at") + 1 < F.size("docs")).select("a", "f", F.slice("docs", F.col("at") + 2, F.size("docs")).alias("bs"))
    return behind.repartition("a").sortWithinPartitions("a").mapInArrow(_shared, f"a {kind}, b {kind}, w double")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, f, bs in order of a -> a, b, w: the sum of f over the lists of a that hold b. No more is held than a batch and the lists of one a."""
    held: pa.Table | None = None

    def summed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        lists = t.column("bs").chunk(0) if t.num_rows else None
        if lists is None:
            return
        parent = pc.list_parent_indices(lists)
        pairs = pa.table({"a": t.column("a").take(parent), "b": pc.list_flatten(lists), "f": t.column("f").take(parent)})
        out = pairs.group_by(["a", "b"], use_threads=False).aggregate([("f", "sum")]).select(["a", "b", "f_sum"]).rename_columns(["a", "b", "w"])
        yield from out.to_batches(max_chunksize=100_000)

    def cut(batch: pa.RecordBatch, most: int = 400_000) -> Iterator[pa.RecordBatch]:
        """Slices of about `most` pairs."""
        total = np.cumsum(pc.list_value_length(batch.column("bs")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end

    for batch in (part for whole in batches for part in cut(whole)):
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = t.column("a")[-1]
        whole = pc.index(t.column("a"), last).as_py()  # rows of one a stand together, the last may go on
        yield from summed(t.slice(0, whole))
        held = t.slice(whole)
    if held is not None:
        yield from summed(held)


def coupling_units(cited: DataFrame, inc: DataFrame, max_docs: int = 2000, fractional: bool = False) -> DataFrame:
    """What unit_links(coupling(cited), inc) gives, without making a pair of documents.

    With c_u(r) the (fractional) documents of unit u that cite r, a reference adds c_u c_v to the link of u and v, less
    what documents that hold both units add by themselves. A reference of n documents costs the square of its units,
    not of n.
    """
    each = inc.select("doc", "key").distinct()
    # rows carry numbers for keys and references, and all units of a document go in one row
    code = stage(each.select("key").distinct().select("key", F.monotonically_increasing_id().alias("u")), "codes")
    units_of = stage(each.join(code, "key").groupBy("doc").agg(F.collect_list("u").alias("us")), "units")
    refs = stage(cited.select("doc", "ref").distinct(), "refs")
    n = refs.groupBy("ref").count().where(F.col("count").between(2, max_docs))
    n = stage(n.select("ref", F.monotonically_increasing_id().alias("r"), (1.0 / (F.col("count") - 1) if fractional else F.lit(1.0)).alias("f")), "cited")
    kept = stage(refs.join(n, "ref").select("doc", "r", "f").join(units_of, "doc"), "kept")
    x = 1.0 / F.size("us") if fractional else F.lit(1.0)
    by_ref = kept.select("r", "f", x.alias("x"), "us").repartition("r").select("r", "f", "x", F.explode("us").alias("u")).groupBy("r", "u").agg(F.sum("x").alias("c"), F.max("f").alias("f"))
    across = by_ref.select("r", F.col("u").alias("a"), F.col("c").alias("ca"), "f").join(by_ref.select("r", F.col("u").alias("b"), F.col("c").alias("cb")), "r").where("a < b").groupBy("a", "b").agg(F.sum(F.col("f") * F.col("ca") * F.col("cb")).alias("w"))
    weight = kept.groupBy("doc").agg(F.sum("f").alias("f"))
    two = units_of.join(weight, "doc").select((F.col("f") * x * x).alias("f"), "us", F.explode("us").alias("a")).select("f", "a", F.explode("us").alias("b")).where("a < b")
    within = two.groupBy("a", "b").agg(F.sum(-F.col("f")).alias("w"))
    both = across.unionByName(within).groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 1e-9")
    named = both.join(code.select(F.col("u").alias("a"), F.col("key").alias("ka")), "a").join(code.select(F.col("u").alias("b"), F.col("key").alias("kb")), "b")
    return named.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "w")


def citation_links(edges: DataFrame) -> DataFrame:
    """(citing, cited) -> a < b, w: both directions add up; a document does not cite itself."""
    return edges.where("citing <> cited").groupBy(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def unit_links(doc_links: DataFrame, inc: DataFrame, fractional: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Links of documents to links of their units: every unit of the one with every other unit of the other.

    Fractional links share a weight among all pairs. Links of a unit to itself go. among: links of these keys (key) alone.
    """
    each = inc.select("doc", "key").distinct()
    if fractional:
        each = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    else:
        each = each.withColumn("n", F.lit(1).cast("long"))
    if among is not None:
        each = each.join(among.select("key"), "key", "left_semi")
    left, right = each.select(F.col("doc").alias("a"), F.col("key").alias("u"), F.col("n").alias("nu")), each.select(F.col("doc").alias("b"), F.col("key").alias("v"), F.col("n").alias("nv"))
    both = doc_links.join(left, "a").join(right, "b").where("u <> v")
    return both.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(F.col("w") / (F.col("nu") * F.col("nv"))).alias("w"))


def unit_strength(doc_links: DataFrame, inc: DataFrame, fractional: bool = False) -> DataFrame:
    """key, tls as total_link_strength of unit_links would give, without making a pair of units.

    A unit of one end of a link gains its weight once for every other unit of the other end.
    """
    of = inc.select("doc", "key").distinct().groupBy("doc").agg(F.collect_list("key").alias("us"))
    both = doc_links.join(of.select(F.col("doc").alias("a"), F.col("us").alias("ua")), "a").join(of.select(F.col("doc").alias("b"), F.col("us").alias("ub")), "b")
    w = F.col("w") / (F.size("ua") * F.size("ub")) if fractional else F.col("w")
    ends = both.select(w.alias("w"), F.explode(F.array(F.struct("ua", "ub"), F.struct(F.col("ub").alias("ua"), F.col("ua").alias("ub")))).alias("x")).select("w", F.col("x.ub").alias("others"), F.explode("x.ua").alias("key"))
    return ends.groupBy("key").agg(F.sum(F.col("w") * (F.size("others") - F.array_contains("others", F.col("key")).cast("int"))).alias("tls"))


def total_link_strength(pairs: DataFrame) -> DataFrame:
    """(a, b, w) -> key, links, tls."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"), "w")
    return ends.groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.sum("w").alias("tls"))


def strength_without_pairs(inc: DataFrame, least: int = 1, fractional: bool = False, max_units: int | None = None) -> DataFrame:
    """key, tls as total_link_strength of cooccurrence would give, without making a pair: a document adds (its kept units - 1) x weight."""
    each = inc.select("doc", "key").repartition("doc").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    if max_units:
        each = each.where(F.col("n") <= max_units)
    kept = frequent(each, least).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    w = F.try_divide(F.lit(1.0), F.col("n") - 1) if fractional else F.lit(1.0)
    return kept.groupBy("key").agg(F.sum(F.coalesce(w, F.lit(0.0)) * (F.col("k") - 1)).alias("tls"))


def normalise(links: DataFrame, how: str = "association") -> DataFrame:
    """(a, b, w) -> a, b, w, s. With k the strength of a node and 2m that of all: association 2m w / (ka kb), fractionalization w/ka + w/kb, linlog w / sqrt(ka kb), none w."""
    tls = total_link_strength(links).select("key", F.greatest("tls", F.lit(1e-12)).alias("k"))
    both = links.join(tls.select(F.col("key").alias("a"), F.col("k").alias("ka")), "a").join(tls.select(F.col("key").alias("b"), F.col("k").alias("kb")), "b")
    w, ka, kb = F.col("w"), F.col("ka"), F.col("kb")
    if how == "association":
        both = both.join(F.broadcast(links.agg(F.sum(2 * F.col("w")).alias("m2"))))  # one row
        s = F.col("m2") * w / (ka * kb)
    else:
        s = {"fractionalization": w / ka + w / kb, "linlog": w / F.sqrt(ka * kb), "none": w}[how]
    return both.select("a", "b", "w", s.alias("s"))


def term_relevance(pairs: DataFrame) -> DataFrame:
    """(a, b, w) -> key, relevance: the divergence of a term's partners from the partners of all, sum p ln(p / q)."""
    half = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    rows = half.groupBy("a").agg(F.sum("w").alias("row"))
    total = rows.agg(F.sum("row").alias("all"))
    both = half.join(rows, "a").join(rows.select(F.col("a").alias("b"), F.col("row").alias("other")), "b").join(F.broadcast(total))
    p, q = F.col("w") / F.col("row"), F.col("other") / F.col("all")
    return both.groupBy(F.col("a").alias("key")).agg(F.sum(p * F.log(p / q)).alias("relevance"))


def relevant_terms(pairs: DataFrame, keep: float = 0.6, least: int = 10) -> DataFrame:
    """key: the most relevant share of terms, at least two; all of them if there are `least` or fewer."""
    ranked = term_relevance(pairs)
    n = ranked.count()
    if n <= least:
        return ranked.select("key")
    return ranked.orderBy(F.desc("relevance"), "key").limit(max(2, -int(-n * keep // 1))).select("key")


def rank_items(stats: DataFrame, pairs: DataFrame, measure: str = "occ", cap: int = 1000) -> DataFrame:
    """key, rank of the strongest `cap` items: by total link strength, measure and key. The cap is the map's own size."""
    return _ranked(stats, total_link_strength(pairs), measure, cap)


def _ranked(stats: DataFrame, tls: DataFrame, measure: str, cap: int) -> DataFrame:
    both = stats.join(tls, "key", "left").select("key", measure, F.coalesce("tls", F.lit(0.0)).alias("tls"))
    top = both.orderBy(F.desc("tls"), F.desc(measure), "key").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tls"), F.desc(measure), "key")))


def links_among(pairs: DataFrame, keys: DataFrame, min_link: float = 0.0) -> DataFrame:
    k = keys.select("key").distinct()
    return pairs.where((F.col("w") > 0) & (F.col("w") >= min_link)).join(k.select(F.col("key").alias("a")), "a", "left_semi").join(k.select(F.col("key").alias("b")), "b", "left_semi")


def sensitivity(stats: DataFrame, measure: str = "occ", most: int = 20) -> DataFrame:
    """m, items: how many items reach each threshold 1..most."""
    levels = F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.floor(measure)).cast("int"))).alias("m")
    counts = stats.where(F.col(measure) >= 1).select(levels).groupBy("m").agg(F.count(F.lit(1)).alias("items"))
    every = stats.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("m"))
    return every.join(counts, "m", "left").select("m", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def suggest_threshold(stats: DataFrame, target: int, measure: str = "occ") -> DataFrame:
    """One row, threshold: the target-th largest measure, rounded up, 1 at least; 1 if there are fewer items."""
    top = stats.orderBy(F.desc(measure)).limit(target)
    return top.agg(F.when(F.count(F.lit(1)) < target, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.min(measure)))).cast("long").alias("threshold"))


def normalised_citations(docs: DataFrame, inc: DataFrame) -> DataFrame:
    """key, norm_citations: the mean over a unit's documents of citations by the year's mean; years without citations do not count."""
    mean = docs.groupBy(F.coalesce("year", F.lit(0)).alias("y")).agg(F.avg("cites").alias("m"))
    scored = docs.withColumn("y", F.coalesce("year", F.lit(0))).join(mean, "y").where("m > 0").select("doc", (F.col("cites") / F.col("m")).alias("score"))
    return inc.select("doc", "key").distinct().join(scored, "doc").groupBy("key").agg(F.avg("score").alias("norm_citations"))


def partner_counts(inc: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each unit (country): docs, cites, partner_pairs (distinct partners of each of its documents) and shared_docs."""
    each = inc.select("doc", "key").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    return each.join(docs.select("doc", "cites"), "doc").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("cites").cast("long").alias("cites"), F.sum(F.col("n") - 1).cast("long").alias("partner_pairs"), F.count_if(F.col("n") > 1).alias("shared_docs"))


def columns_of(spec: MapSpec) -> list[str]:
    """The columns of records that a map reads."""
    more = ("refs",) if spec.analysis == "coupling" else ("refs", "doi", "volume", "pages", "authors") if spec.analysis == "citation" else ()
    return list(dict.fromkeys(("rec_id", "year", "cites", *units.columns_of(spec.unit), *more)))


def _documents(records: DataFrame, spec: MapSpec) -> tuple[DataFrame, DataFrame]:
    """The records in the map's years, and doc, year, cites of them."""
    rec = records.where(units.in_years(F.col("year"), spec.year_from, spec.year_to))
    return rec, rec.select(F.col("rec_id").alias("doc"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("cites", F.lit(0)).alias("cites"))


def _together(spec: MapSpec) -> bool:
    """Whether pairs are units that stand in one document."""
    return spec.analysis in ("cooccurrence", "coauthorship", "cocitation")


def _most_units(spec: MapSpec) -> int | None:
    return spec.max_authors if spec.analysis == "coauthorship" and spec.max_authors > 0 else None


def _strong(inc: DataFrame, docs: DataFrame, spec: MapSpec) -> DataFrame:
    """The incidence of units with documents and citations enough to be linked through documents."""
    kept = inc.join(docs.select("doc", "cites"), "doc")
    strong = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("cites").alias("c")).where((F.col("n") >= spec.minimum) & (F.col("c") >= spec.min_cites))
    return inc.join(strong, "key", "left_semi")


def _pairs(rec: DataFrame, inc: DataFrame, docs: DataFrame, spec: MapSpec) -> DataFrame:
    if _together(spec):
        return cooccurrence(inc, spec.minimum, spec.fractional, _most_units(spec))
    if spec.analysis == "coupling":
        cited = units.incidence(rec, "refs").select("doc", F.col("key").alias("ref"))
        doc_pairs = coupling(cited, spec.max_ref_docs, spec.fractional) if spec.unit == "documents" else None
    else:
        doc_pairs = citation_links(match.match_refs_strict(rec))
    if spec.unit == "documents":
        return links_of_documents(doc_pairs, inc.join(docs.select("doc", "cites"), "doc").where(F.col("cites") >= max(spec.minimum, spec.min_cites)).select("doc", "key"))
    if doc_pairs is None:
        return coupling_units(cited, _strong(inc, docs, spec), spec.max_ref_docs, spec.fractional)
    return unit_links(doc_pairs, _strong(inc, docs, spec), spec.fractional)


def raw_pairs(records: DataFrame, spec: MapSpec, thesaurus: DataFrame | None = None, exclusions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidence, documents, pairs) of a map query; pairs are over item keys that reach the minimum."""
    rec, docs = _documents(records, spec)
    inc = units.incidence(rec, spec.unit, thesaurus, exclusions)
    return inc, docs, _pairs(rec, inc, docs, spec)


def links_of_documents(doc_pairs: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("doc").distinct()
    both = doc_pairs.join(ids.select(F.col("doc").alias("a")), "a", "left_semi").join(ids.select(F.col("doc").alias("b")), "b", "left_semi")
    x, y = F.col("a").cast("string"), F.col("b").cast("string")
    return both.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "w")


def build_map(records: DataFrame, spec: MapSpec = MapSpec(), thesaurus: DataFrame | None = None, exclusions: DataFrame | None = None, labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a map: thresholds, relevance of terms, rank and cap, links, largest component, weights and scores.

    Pairs of all items are made only where selection needs them (terms, coupling, documents). Otherwise strengths are
    counted without pairs, the strongest items are chosen, and only these are paired. Without `labels` nodes have none.
    Raises ValueError where no record or fewer than two items are left.
    """
    if not records.take(1):
        raise ValueError("there are no records")
    rec, docs = _documents(records, spec)
    inc = units.incidence(rec, spec.unit, thesaurus, exclusions)
    inc, docs = stage(inc if labels else inc.select("doc", "key"), "incidence"), stage(docs, "documents")  # each is read several times
    stats = stage(item_stats(inc, docs), "items")
    measure = "cites" if spec.unit == "documents" else "occ"
    stats = stats.where(F.col(measure) >= spec.minimum)
    if _together(spec) and spec.unit != "terms":
        most = _most_units(spec)
        top = stage(_ranked(stats, strength_without_pairs(inc, spec.minimum, spec.fractional, most), measure, spec.max_items), "top")
        pairs = cooccurrence(inc, spec.minimum, spec.fractional, most, top)
    elif spec.analysis == "citation" and spec.unit != "documents":
        doc_pairs, strong = stage(citation_links(match.match_refs_strict(rec)), "cited"), _strong(inc, docs, spec)
        top = stage(_ranked(stats, unit_strength(doc_pairs, strong, spec.fractional), measure, spec.max_items), "top")
        pairs = unit_links(doc_pairs, strong, spec.fractional, top)
    else:
        pairs = stage(_pairs(rec, inc, docs, spec), "pairs")
        if spec.unit == "terms":
            stats = stats.join(relevant_terms(pairs, spec.term_keep), "key", "left_semi")
            pairs = links_among(pairs, stats)
        top = stage(rank_items(stats, pairs, measure, spec.max_items), "top")
    links = stage(links_among(pairs, top, spec.min_link), "links")
    keys = top.select("key")
    if spec.largest:
        keys = stage(largest_component(links), "largest")
        links = links_among(links, keys)
    links = normalise(links, spec.normalisation)
    if len(keys.take(2)) < 2:
        raise ValueError("fewer than two items reach the thresholds")
    nodes = keys.join(stats, "key").join(total_link_strength(links), "key", "left").join(normalised_citations(docs, inc.join(keys, "key", "left_semi")), "key", "left")
    if labels:
        nodes = nodes.join(units.first_labels(inc), "key")
    nodes = nodes.select("key", *["label"] * labels, F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("tls", F.lit(0.0)).alias("total_link_strength"), F.col("occ").alias("occurrences"), F.col("cites").alias("citations"), "avg_year", (F.col("cites") / F.col("occ")).alias("avg_citations"), "norm_citations")
    return nodes, links


def records_flow(found: DataFrame, kept: DataFrame, spec: MapSpec = MapSpec(), thesaurus: DataFrame | None = None, exclusions: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """One row of counts, from the records found to the items of their map.

    found: records as read, kept: those left by deduplication (rec_id). identified = duplicates + screened; screened =
    outside_years + without_units + analysed; items_found of which items_meeting reach the minimum (of citations, too,
    where the analysis asks for them), items_excluded of these by hand (exclusions); items_in_map counts nodes, null
    where no map is given. A record counts as analysed if it holds a unit. An empty table gives zeros. Counts are aggregates, so a task that runs twice counts once.
    """
    one = kept.select("rec_id").distinct()
    here = found.join(one, "rec_id", "left_semi").select("*", units.in_years(F.col("year"), spec.year_from, spec.year_to).alias("in_years"))
    rec = here.where("in_years").drop("in_years")
    inc = units.incidence(rec, spec.unit, thesaurus)
    cites = rec.select(F.col("rec_id").alias("doc"), F.coalesce("cites", F.lit(0)).alias("c"))
    items = inc.join(cites, "doc").groupBy("key").agg(F.count(F.lit(1)).alias("occ"), F.sum("c").alias("cites"))
    by_cites = spec.analysis in ("citation", "coupling")
    measure = F.col("cites") if spec.unit == "documents" else F.col("occ")
    meets = (measure >= spec.minimum) & ((F.col("cites") >= spec.min_cites) if by_cites else F.lit(True))
    if exclusions is not None:
        items = items.join(exclusions.select("key").distinct().withColumn("out", F.lit(True)), "key", "left")
    else:
        items = items.withColumn("out", F.lit(None).cast("boolean"))
    long = lambda c: c.cast("long")
    row = found.agg(F.count(F.lit(1)).alias("identified")).join(here.agg(F.count(F.lit(1)).alias("screened"), F.count_if(~F.col("in_years")).alias("outside_years")))
    row = row.join(inc.agg(F.count_distinct("doc").alias("analysed"))).join(items.agg(F.count(F.lit(1)).alias("items_found"), F.count_if(meets).alias("items_meeting"), F.count_if(meets & F.col("out")).alias("items_excluded")))
    row = row.join(nodes.agg(F.count(F.lit(1)).alias("items_in_map"))) if nodes is not None else row.withColumn("items_in_map", long(F.lit(None)))
    duplicates, without = F.col("identified") - F.col("screened"), F.col("screened") - F.col("outside_years") - F.col("analysed")
    return row.select("identified", duplicates.alias("duplicates"), "screened", "outside_years", without.alias("without_units"), "analysed", "items_found", "items_meeting", "items_excluded", "items_in_map")
