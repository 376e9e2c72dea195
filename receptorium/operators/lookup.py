"""Record lookup: request resolution, exact hits, ids, pairs, concordance, V/J inference, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from receptorium.constants import INDEX_COLUMNS, MAX_NEIGHBOURS, STALE_DAYS
from receptorium.functions import parsing, text
from receptorium.operators.pairwise import first_rows
from receptorium.operators.similar import nearest_records
from receptorium.session import cut_lineage, sent_if_small, spread

REQUEST_FIELDS = ["query", "cdr3_aa", "cdr3_aa_b", "v_gene", "j_gene", "species"]
SPEC = ["scope", "cdr3_key", "v_key", "j_key"]
SEARCHES_SENT = 500_000
NO_PAIR_MESSAGE = "no shared pairing_key between the two chains"


def with_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    for f in fields:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("string"))
    return df


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def resolve_requests(queries: DataFrame) -> DataFrame:
    """One row per request with the fields to search on.

    A species found in the text wins; other parsed fields only fill NULLs; an id replaces the text.
    What is left of the text is classified when no field is set.
    """
    q = with_fields(queries, REQUEST_FIELDS).withColumn("_p", parsing.parse_text(F.col("query")))
    free = F.col("_p.record_id").isNull()
    q = q.select(
        "qid",
        F.coalesce(F.col("_p.record_id"), F.col("query")).alias("query"),
        F.coalesce("cdr3_aa", F.when(free, F.col("_p.cdr3_aa"))).alias("cdr3_aa"),
        "cdr3_aa_b",
        F.coalesce("v_gene", F.when(free, F.col("_p.v_gene"))).alias("v_gene"),
        F.coalesce("j_gene", F.when(free, F.col("_p.j_gene"))).alias("j_gene"),
        F.coalesce("_p.species", "species").alias("species"),
    )
    bare = F.coalesce(*[_given(F.col(c)) for c in ("cdr3_aa", "cdr3_aa_b", "v_gene", "j_gene")]).isNull()
    t = text.strip(F.col("query"))
    q = q.withColumn("_c", F.when(bare & _given(F.col("query")).isNotNull(), parsing.classify(F.col("query"))))
    kind, norm = F.col("_c.detected_type"), F.col("_c.normalized")
    is_id = F.col("_c").isNotNull() & (t.rlike(parsing.ID_PREFIX_PATTERN) | (kind == "id"))
    is_gene = kind.isin("gene_name", "allele") & ~is_id
    segment = text.segment_letter(norm)
    return q.select(
        "qid", F.col("query"),
        F.when((kind == "raw_aa") & ~is_id & F.length(norm).between(8, 22), norm)
        .otherwise(F.col("cdr3_aa")).alias("cdr3_aa"),
        "cdr3_aa_b",
        F.when(is_gene & (segment == "V"), norm).otherwise(F.col("v_gene")).alias("v_gene"),
        F.when(is_gene & (segment == "J"), norm).otherwise(F.col("j_gene")).alias("j_gene"),
        "species",
        F.when(is_id, F.when(t.rlike(parsing.ID_PREFIX_PATTERN), t).otherwise(norm)).alias("id_lookup"),
    )


def search_keys(requests: DataFrame) -> DataFrame:
    """Requests with their search keys; an absent field is the empty string, no species is ``*``."""
    return requests.select(
        "*",
        F.coalesce(F.nullif(text.species_key(F.col("species")), F.lit("")), F.lit("*")).alias("scope"),
        F.coalesce(F.upper(text.strip(F.col("cdr3_aa"))), F.lit("")).alias("cdr3_key"),
        text.gene_base(F.col("v_gene")).alias("v_key"),
        text.gene_base(F.col("j_gene")).alias("j_key"),
    )


def searchable(index: DataFrame) -> DataFrame:
    """Index with its match keys."""
    return index.select(
        "*",
        F.upper(F.coalesce("cdr3_aa", F.lit(""))).alias("i_cdr3"),
        text.gene_base(F.col("v_gene")).alias("i_v"),
        text.gene_base(F.col("j_gene")).alias("i_j"),
        text.species_key(F.col("species")).alias("i_species"),
        text.mhc_organism(F.col("mhc_a")).alias("mhc_organism"),
        text.score_number(F.col("score")).alias("score_rank"),
    )


def in_scope(scope: Column, include_cross_species: bool) -> Column:
    """Species gate: the species matches and, unless asked otherwise, the MHC is not another organism's."""
    own = F.col("i_species") == scope
    if not include_cross_species:
        own = own & (F.col("mhc_organism").isNull() | (F.col("mhc_organism") == scope))
    return (scope == "*") | own


def exact_hits(specs: DataFrame, index: DataFrame, include_cross_species: bool = False) -> DataFrame:
    """Index rows of every distinct search: AND over the fields given.

    A search is found through its most selective key (CDR3, else V, else J), so one scan of the
    index and one equi-join serve all searches. Up to SEARCHES_SENT searches go to every task, since index rows shuffled
    by their few genes are uneven.
    """
    wanted = specs.select(*SPEC).distinct().withColumn("_key", (
        F.when(F.col("cdr3_key") != "", F.concat(F.lit("c:"), "cdr3_key"))
        .when(F.col("v_key") != "", F.concat(F.lit("v:"), "v_key"))
        .when(F.col("j_key") != "", F.concat(F.lit("j:"), "j_key")))).filter(F.col("_key").isNotNull())
    keys = [F.when(F.col(c) != "", F.concat(F.lit(tag), c)) for tag, c in (("c:", "i_cdr3"), ("v:", "i_v"), ("j:", "i_j"))]
    rows = searchable(index).withColumn("_key", F.explode(F.array_compact(F.array(*keys))))  # nobody asks for an empty key
    return rows.join(sent_if_small(wanted, SEARCHES_SENT), "_key").filter(
        ((F.col("v_key") == "") | (F.col("v_key") == F.col("i_v")))
        & ((F.col("j_key") == "") | (F.col("j_key") == F.col("i_j")))
        & in_scope(F.col("scope"), include_cross_species)).drop("_key")


HIT_ORDER = ["score_rank", "source", "src_row"]


def ranked_hits(hits: DataFrame, keys: list[str], top_k: int) -> DataFrame:
    order = [F.col("score_rank").desc(), F.col("source"), F.col("src_row")]
    return first_rows(hits, keys, order, top_k)


def concordance(index: DataFrame) -> DataFrame:
    """Distinct sources per CDR3 over a whole table, at least one."""
    return (index.filter(F.col("cdr3_aa").isNotNull()).groupBy(F.upper("cdr3_aa").alias("cdr3_key"))
            .agg(F.greatest(F.count_distinct("source"), F.lit(1)).alias("concordance")))


def _concordance_of(rows: DataFrame, index: DataFrame, include_cross_species: bool) -> DataFrame:
    """(scope, i_cdr3) pairs of ``rows`` with the number of sources seen inside that scope."""
    needed = sent_if_small(rows.filter(F.col("i_cdr3") != "").select("scope", "i_cdr3").distinct(), SEARCHES_SENT)
    inside = searchable(index.select("cdr3_aa", "source", "species", "mhc_a", "v_gene", "j_gene", "score")) \
        .join(needed, "i_cdr3").filter(in_scope(F.col("scope"), include_cross_species))
    return inside.groupBy("scope", "i_cdr3").agg(F.count_distinct("source").alias("concordance"))


def _record(df: DataFrame) -> DataFrame:
    """Response columns of a record."""
    return df.withColumns({
        "score": F.col("score").try_cast("double"),
        "species": F.coalesce("species", F.lit("")),
        "mhc_is_cross_species": text.mhc_is_cross_species(F.col("mhc_a"), F.col("species")),
    })


def id_hits(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose record id is asked for verbatim; no species gate."""
    ids = requests.filter(F.col("id_lookup").isNotNull()).select("qid", F.col("id_lookup").alias("source_record_id"))
    return searchable(index).join(sent_if_small(ids), "source_record_id").withColumn("scope", F.lit("*"))


def retrieve_records(queries: DataFrame, index: DataFrame, top_k: int = 50, include_neighbours: bool = True,
                     include_cross_species: bool = False) -> dict[str, DataFrame]:
    """Answer a table of lookup requests.

    Returns long tables keyed by ``qid``: exact, neighbours, pairs, warnings, totals.
    """
    requests = cut_lineage(search_keys(resolve_requests(queries)))  # read by every branch below
    by_id = requests.filter(F.col("id_lookup").isNotNull())
    searches = requests.filter(F.col("id_lookup").isNull()
                               & ((F.col("cdr3_key") != "") | (F.col("v_key") != "") | (F.col("j_key") != "")))

    hits = exact_hits(searches, index, include_cross_species)
    stats = hits.select(*SPEC, "chain").groupBy(*SPEC).agg(F.count(F.lit(1)).alias("total_matches"),
                                    F.array_sort(F.collect_set("chain")).alias("chains"))
    capped = ranked_hits(hits, SPEC, top_k)
    exact = cut_lineage(searches.select("qid", *SPEC).join(capped, SPEC))

    ids = id_hits(by_id, index)
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("src_row")))

    # second chain of a pair request
    paired = searches.filter(F.coalesce(F.col("cdr3_aa_b"), F.lit("")) != "").select(
        "qid", "scope", F.upper(text.strip(F.col("cdr3_aa_b"))).alias("b_cdr3"))
    mates = searchable(index)
    b_side = mates.select("pairing_key", F.col("i_cdr3").alias("b_cdr3"), "i_species", "mhc_organism",
                          F.col("chain").alias("b_chain"), F.col("source_record_id").alias("b_id"),
                          F.col("v_gene").alias("b_v"), F.col("j_gene").alias("b_j"), F.col("src_row").alias("b_row"))
    a_side = exact.select("qid", "pairing_key", "source", F.col("chain").alias("a_chain"),
                          F.col("source_record_id").alias("a_id"), F.col("cdr3_aa").alias("a_cdr3"),
                          F.col("v_gene").alias("a_v"), F.col("j_gene").alias("a_j"), F.col("src_row").alias("a_row"))
    met = a_side.join(paired, "qid").join(b_side, ["pairing_key", "b_cdr3"]) \
        .filter(in_scope(F.col("scope"), include_cross_species)
                & (((F.col("a_chain") == "alpha") & (F.col("b_chain") == "beta"))
                   | ((F.col("a_chain") == "beta") & (F.col("b_chain") == "alpha"))))
    a_is_alpha = F.col("a_chain") == "alpha"
    pairs = met.select(
        "qid", "pairing_key",
        "source",
        *[F.when(a_is_alpha, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"alpha_{n}")
          for c, n in (("id", "record_id"), ("cdr3", "cdr3"), ("v", "v_gene"), ("j", "j_gene"), ("row", "row"))],
        *[F.when(a_is_alpha, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"beta_{n}")
          for c, n in (("id", "record_id"), ("cdr3", "cdr3"), ("v", "v_gene"), ("j", "j_gene"), ("row", "row"))],
    )
    lone = cut_lineage(paired.join(pairs.select("qid").distinct(), "qid", "left_anti"))
    appended = mates.join(lone.withColumnRenamed("b_cdr3", "i_cdr3"), "i_cdr3") \
        .filter(in_scope(F.col("scope"), include_cross_species))

    have = [c for c in INDEX_COLUMNS if c in index.columns]
    shape = ["qid", "scope", "i_cdr3", "rank", "part", *have, "src_row", "mhc_organism"]
    found = cut_lineage(exact.withColumn("part", F.lit("exact")).select(*shape)
             .unionByName(ids.withColumn("part", F.lit("id")).select(*shape))
             .unionByName(appended.withColumn("part", F.lit("second_chain"))
                          .withColumn("rank", F.lit(None).cast("int")).select(*shape)))
    seen = _concordance_of(found, index, include_cross_species)  # an id lookup has the scope *
    found = found.join(seen, ["scope", "i_cdr3"], "left")
    exact_out = _record(found).select(
        "qid", "part", "rank", *have, "src_row", "mhc_organism", "mhc_is_cross_species", F.lit("exact").alias("match_kind"),
        F.greatest(F.coalesce("concordance", F.lit(1)), F.lit(1)).alias("concordance"))

    out = {"requests": requests, "exact": exact_out, "pairs": pairs}
    if include_neighbours:
        with_cdr3 = searches.filter(F.col("cdr3_key") != "").select("qid", *SPEC).join(stats, SPEC, "left")
        probes = with_cdr3.select(
            "qid", "scope", F.col("cdr3_key").alias("cdr3"), F.lit("*").alias("family"),
            F.explode(F.when(F.coalesce(F.size("chains"), F.lit(0)) > 0, F.col("chains"))
                      .otherwise(F.array(F.lit("*")))).alias("chain"))
        near = nearest_records(probes, index, MAX_NEIGHBOURS, mhc_gate=not include_cross_species,
                               skip_identical=True)
        out["neighbours"] = near.withColumns({
            "similarity": F.round(text.similarity(F.col("distance"), F.col("max_distance")), 4),
            "match_kind": F.lit("neighbour"), "concordance": F.lit(1)})
    out["totals"] = (requests.select("qid", *SPEC).join(stats.select(*SPEC, "total_matches"), SPEC, "left")
                     .join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("total_exact")), "qid", "left")
                     .select("qid", F.coalesce("total_exact", F.lit(0)).alias("total_exact"),
                             F.coalesce("total_matches", F.lit(0)).alias("total_matches")))
    out["warnings"] = request_warnings(requests).unionByName(no_pair_warnings(lone))
    return out


def _warning(df: DataFrame, code: str, block: str, message: Column) -> DataFrame:
    return df.select("qid", F.lit(code).alias("code"), F.lit(block).alias("block"), message.alias("message"))


def request_warnings(requests: DataFrame) -> DataFrame:
    """Non-standard residues of either CDR3 of a request."""
    chains = requests.select("qid", F.explode(F.array(
        F.struct(F.lit("cdr3").alias("label"), F.col("cdr3_aa").alias("seq")),
        F.struct(F.lit("cdr3_b").alias("label"), F.col("cdr3_aa_b").alias("seq")))).alias("x"))
    bad = chains.select("qid", "x.label", text.nonstandard_residues(F.col("x.seq")).alias("letters")) \
        .filter(F.size("letters") > 0)
    return _warning(bad, "nonstandard_residues", "records", F.format_string(
        "%s has letters outside the standard residues: %s; matches may be incomplete.",
        F.col("label"), F.array_join("letters", ", ")))


def no_pair_warnings(lone: DataFrame) -> DataFrame:
    return _warning(lone, "no_pairing_found", "pairs", F.lit(NO_PAIR_MESSAGE))


def index_warnings(meta: DataFrame, today: Column | None = None, max_age: int = STALE_DAYS) -> DataFrame:
    """Age of an index in days and whether it is stale; an unknown age is not stale."""
    age = F.datediff(today if today is not None else F.current_date(), F.col("built_at").try_cast("date"))
    return meta.select("*", age.alias("age_days"), F.coalesce(age > max_age, F.lit(False)).alias("is_stale"))


def infer_genes(cdr3s: DataFrame, index: DataFrame, top: int = 5) -> DataFrame:
    """V/J pairings of the records that carry exactly a CDR3, by support.

    ``cdr3s`` has qid, cdr3_aa, species (NULL: any). Equal counts rank by V, then J. Records are counted before they meet
    the CDR3 asked for, in tasks of a bounded number of records.
    """
    size = index.count()
    asked = cdr3s.select("qid", F.upper(text.strip(F.col("cdr3_aa"))).alias("i_cdr3"),
                         F.nullif(text.species_key(F.col("species")), F.lit("")).alias("asked_species")) \
        .filter(F.col("i_cdr3") != "")
    tallies = searchable(index).select("i_cdr3", "i_species", "i_v", "i_j") \
        .filter((F.col("i_cdr3") != "") & (F.col("i_v") != "") & (F.col("i_j") != "")) \
        .groupBy("i_cdr3", "i_species", "i_v", "i_j").agg(F.count(F.lit(1)).alias("n"))
    distinct = asked.select("i_cdr3", "asked_species").distinct()
    counted = (spread(distinct, "i_cdr3", rows=size).join(spread(tallies, "i_cdr3", rows=size), "i_cdr3")
               .filter(F.col("asked_species").isNull() | (F.col("asked_species") == F.col("i_species")))
               .groupBy("i_cdr3", "asked_species", "i_v", "i_j").agg(F.sum("n").alias("n")))
    ranked = first_rows(counted, ["i_cdr3", "asked_species"],
                        [F.col("n").desc(), F.col("i_v"), F.col("i_j")], top)
    same = (F.col("a.i_cdr3") == F.col("r.i_cdr3")) & F.col("a.asked_species").eqNullSafe(F.col("r.asked_species"))
    return asked.alias("a").join(ranked.alias("r"), same).select(
        "a.qid", "r.rank",
        F.coalesce(text.chain_label_strict(F.col("i_v")), text.chain_label_strict(F.col("i_j"))).alias("chain"),
        F.col("i_v").alias("v_gene"), F.col("i_j").alias("j_gene"), F.col("n").alias("count"))
