"""The library's operators on the driver's tables. SQL that says the same is in parlance.oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import levels, signal, tags, text
from parlance.functions.loose_json import list_in, read_reply
from parlance.operators import alignment, assembly, cache, catalog, filtering, items, metrics, placement, prompts, quota, records, timeline, validation, verdicts
from parlance.plans import allocation, batches
from parlance.session import kept, scratch
from parlance.sources.store import KeyedStore
from parlance.sources.tables import merge_summaries, parquet
from parlance.streaming import attempts as stream_attempts
from parlance.streaming import events as stream_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CLASSES = ["0", "1"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- agreement and recovery -----------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))


def _with_lang(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).join(parquet(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query
def confusion_long(spark, d):
    return metrics.count_pairs(_pairs(spark, d))


@query
def confusion_dense(spark, d):
    pairs = _pairs(spark, d).withColumn("pred", F.when(F.col("doc_id") % 7 == 0, "??").otherwise(F.col("pred")))
    return metrics.dense_confusion(metrics.count_pairs(pairs), [*CLASSES, "2"], "invalid")


@query
def confusion_row_norm(spark, d):
    return metrics.row_normalised(metrics.dense_confusion(metrics.count_pairs(_pairs(spark, d)), CLASSES))


@query
def per_class_prf(spark, d):
    return metrics.per_class(metrics.count_pairs(_pairs(spark, d)), [*CLASSES, "2"])


@query
def macro_prf(spark, d):
    return metrics.macro(metrics.per_class(metrics.count_pairs(_pairs(spark, d)), [*CLASSES, "2"]))


@query
def kappa(spark, d):
    return metrics.kappa(metrics.count_pairs(_pairs(spark, d)), CLASSES)


@query
def metrics_by_stratum(spark, d):
    counts = metrics.count_pairs(_with_lang(spark, d), ("lang",))
    every = counts.groupBy("gold", "pred").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("all"))
    both = counts.unionByName(every)
    return metrics.macro(metrics.per_class(both, CLASSES, ("lang",)), ("lang",)).join(metrics.kappa(both, CLASSES, ("lang",)), "lang")


@query
def balanced_accuracy(spark, d):
    classes = metrics.per_class(metrics.count_pairs(_pairs(spark, d)), CLASSES, empty=0.0)
    return classes.agg(metrics.ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


@query
def mcnemar_exact(spark, d):
    cells = _with_lang(spark, d).groupBy("lang", "source").agg(F.count_if(F.expr("gold = '1' AND pred = '0'")).alias("correct"), F.count_if(F.expr("gold = '0' AND pred = '1'")).alias("reversed"))
    return cells.withColumn("p", F.round(metrics.mcnemar_p(F.col("correct"), F.col("reversed")), 9))


@query
def paired_table(spark, d):
    rows = parquet(spark, d, "labels").select((F.col("doc_id") - F.col("doc_id") % 2).alias("pair_id"), (F.col("doc_id") % 2 == 0).alias("gold"), F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("pred"))
    found = metrics.paired_table(rows)
    return found.withColumn("mcnemar_p", F.round("mcnemar_p", 9))


@query
def share_vs_base(spark, d):
    rows = parquet(spark, d, "events").withColumn("team", F.col("user_id") % 3)
    return metrics.shares_against_base(rows, "event_type", F.col("value") > 50, ("team",))


@query
def upper_median_words(spark, d):
    rows = parquet(spark, d, "conversations").select("role", F.size(text.words(F.col("text"))).cast("long").alias("w"))
    return metrics.upper_medians(rows, "w", ("role",))


@query
def top5_ties(spark, d):
    return metrics.top_k(parquet(spark, d, "events"), "user_id", "event_id", 5, ("event_type",)).withColumn("rank", F.col("rank").cast("long"))


# --- items ----------------------------------------------------------------------------------


def _items(spark, d):
    rows = parquet(spark, d, "benchmark").select("item_id", text.words(F.lower("text")).alias("w"))
    rows = rows.select("item_id", "w", F.element_at("w", -1).alias("gold"))
    return rows.withColumn("options", items.options(F.col("item_id").cast("string"), F.col("gold"), F.col("w")))


@query
def mcq_items(spark, d):
    return _items(spark, d).where(F.col("options").isNotNull()).select("item_id", "gold", F.array_join("options", " / ").alias("options"))


def _answers(spark, d):
    reply = F.when(F.col("item_id") % 3 == 0, F.upper("gold")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("it is "), F.get("w", F.lit(0)))).otherwise(F.lit(""))
    rows = _items(spark, d).where(F.col("options").isNotNull())
    value = F.when(F.col("item_id") % 4 == 1, F.to_json(F.struct(F.lit(1).alias("n"), reply.alias("choice")))).otherwise(reply)
    return rows.withColumn("answer", text.read_choice(text.field_of(value, text.ANSWER_FIELDS), F.col("options")))


@query
def mcq_score(spark, d):
    return items.score_choices(_answers(spark, d).withColumn("group", F.col("item_id") % 3), ("group",))


@query
def mcq_positions(spark, d):
    return items.answer_positions(_answers(spark, d))


@query
def frequent_answers(spark, d):
    return items.frequent_answers(_answers(spark, d))


@query
def summary_items(spark, d):
    scenes = parquet(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return items.summary_items(scenes, "conv_id")


@query
def grounding_items(spark, d):
    base = _manifests(spark, d).withColumn("audio", F.concat(F.lit("/scenes/"), F.col("conv_id"), F.lit(".wav")))
    i, rank = F.col("conv_id"), F.col("rank")
    event = lambda e: F.struct(
        e["event_id"].alias("event_id"), F.when(~((i % 4 == 0) & (rank == 1)), e["start_s"]).alias("start_s"),
        F.when(e["turn"] % 3 > 0, F.when(rank == 0, e["turn"] % 2 == 1).otherwise(e["turn"] >= i % 9)).alias("muted"),
    )
    gone = base.withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).where((i + rank) % 3 < 2).withColumn("events_placed", F.transform("events_placed", event))
    gone = gone.withColumn("audio", F.concat(F.lit("/without"), rank, F.lit("/"), i, F.lit(".wav")))
    return items.grounding_items(base.withColumn("events_placed", F.when(i % 5 == 0, F.slice("events_placed", 1, 2)).otherwise(F.col("events_placed"))), gone, "conv_id")


# --- timelines ------------------------------------------------------------------------------


def _turns(spark, d):
    return parquet(spark, d, "conversations")


@query
def event_runs(spark, d):
    found = timeline.runs(parquet(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return found.where("length >= 2")


@query
def timeline_position(spark, d):
    rows = timeline.utterances_before(_turns(spark, d), "conv_id", "turn", F.col("role") == "user")
    slot = F.element_at(F.array(*[F.lit(s) for s in timeline.SLOTS]), (F.col("turn") % 3 + 1).cast("int"))
    rows = rows.where("role = 'assistant'").withColumn("slot", slot)
    return rows.select("conv_id", "turn", "seen", "total", "slot", timeline.slot_ok(F.col("seen"), F.col("total"), F.col("slot")).alias("fits"))


@query
def after_turn_idx(spark, d):
    rows = timeline.utterances_before(_turns(spark, d), "conv_id", "turn", F.col("role") == "user")
    return rows.where("role <> 'user'").select("conv_id", "turn", "after_turn")


@query
def speaker_anchor(spark, d):
    rows = _turns(spark, d).withColumn("speaker", F.col("turn") % 2)
    return timeline.nearest_same(rows, "conv_id", "turn", "speaker", F.col("role") == "user").select("conv_id", "turn", "anchor")


@query
def next_utterance(spark, d):
    rows = _turns(spark, d).withColumn("n_chars", F.length("text").cast("long"))
    return timeline.next_utterance(rows, "conv_id", "turn", F.col("role") == "user", "turn", "n_chars").select("conv_id", "turn", "next_turn", "next_n_chars")


@query
def pack_chunks(spark, d):
    return timeline.pack_in_order(_turns(spark, d), "conv_id", "turn", F.length("text"), 2000)


@query
def midpoint_bounds(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = parquet(spark, d, "events").select("user_id", "event_id", start.alias("start")).withColumn("end", F.col("start") + 1.5)
    return timeline.midpoint_bounds(rows, "user_id", ["start", "event_id"], "start", "end").select("event_id", "bound_start", "bound_end")


@query
def pause_gap(spark, d):
    time = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return timeline.first_gap(parquet(spark, d, "events"), "user_id", ["ts", "event_id"], time, 3600.0).withColumn("gap", F.round("gap", 4))


def _rules():
    said = F.coalesce(F.trim("text"), F.lit(""))
    forbidden = [(label, F.col("text").rlike(pattern)) for label, pattern in text.FORBIDDEN]
    return [("invalid speaker", ~F.col("role").isin("user", "assistant")), ("empty text", said == ""), *forbidden, ("too long", F.size(text.words(text.strip_tags(F.col("text")))) > 60)]


@query
def validation_reason(spark, d):
    return timeline.first_failure(_turns(spark, d), "conv_id", "turn", _rules())


@query
def turn_cap(spark, d):
    rows = _turns(spark, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_utterances"), F.count_if(F.col("role") == "assistant").alias("n_events"), F.max((F.col("role") == "system").cast("int")).alias("p"))
    most = timeline.most_turns(F.col("p") == 1, F.col("n_events"), 2)
    reason = F.when(F.col("n_utterances") < 2, "too few").when(F.col("n_utterances") > most, "too many")
    return rows.select("conv_id", "n_utterances", most.alias("most"), reason.alias("reason"))


@query
def timeline_report(spark, d):
    """Per conversation: turns, words, longest run of a role, last position of a reply, and the first broken rule."""
    turns = _turns(spark, d).withColumn("w", F.size(text.words(F.col("text"))).cast("long"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("w").alias("n_words"), F.max("w").alias("longest_turn"))
    run = timeline.runs(turns, "conv_id", ["turn"], "role").groupBy("conv_id").agg(F.max("length").alias("longest_run"))
    return sizes.join(run, "conv_id").join(timeline.first_failure(turns, "conv_id", "turn", _rules()), "conv_id")


@query
def shifted_turns(spark, d):
    start = F.col("turn") * 2.0
    rows = _turns(spark, d).select("conv_id", "turn", start.alias("start"), (start + 1.5).alias("end"), ((F.length("text") % 4) * 0.25).alias("gap"))
    return placement.shifted_turns(rows, "conv_id", "turn", "start", "end", "gap").select("conv_id", "turn", "new_start", "new_end")


@query
def rescaled_turns(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 2.0).alias("end"), (F.col("conv_id") % 17 + 2.0).alias("audio"))
    found = placement.rescaled(rows, "conv_id", "start", "end", "audio")
    return found.select("conv_id", "turn", F.round("factor", 9).alias("factor"), F.round("new_end", 9).alias("new_end"))


@query
def sample_spans(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", placement.sample_span(F.col("turn") - 0.5, F.col("turn") + 0.75, F.lit(200_000)).alias("s"))
    return rows.select("conv_id", "turn", "s.first", "s.last")


@query
def chunk_offsets(spark, d):
    chunks = timeline.pack_in_order(_turns(spark, d), "conv_id", "turn", F.length("text"), 2000).withColumn("seconds", F.col("size") / 16.0)
    return placement.offset_chunks(chunks, "conv_id", "chunk", "seconds").select("conv_id", "chunk", "offset")


# --- texts ----------------------------------------------------------------------------------


@query
def forbidden_pattern_hits(spark, d):
    docs = parquet(spark, d, "documents")
    return docs.select("doc_id", text.first_forbidden(F.col("text")).alias("label")).where("label IS NOT NULL")


@query
def tag_strip(spark, d):
    stripped = text.strip_markup(F.col("html"))
    return parquet(spark, d, "pages").select("page_id", F.length(stripped).cast("long").alias("n"), F.md5(stripped.cast("binary")).alias("digest"))


@query
def prosody_strip(spark, d):
    tagged = F.concat(F.lit("[sighs] "), F.col("text"), F.lit(" [laughs softly] end"))
    return _turns(spark, d).select("conv_id", "turn", text.strip_tags(tagged).alias("spoken"))


@query
def degenerate_text(spark, d):
    found = text.degeneracy(parquet(spark, d, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_words", "top_word_count", "top_run_count")], "reason")


@query
def quote_evidence(spark, d):
    """Benchmark passages that documents quote."""
    return text.quoted(parquet(spark, d, "documents"), "doc_id", "text", parquet(spark, d, "benchmark"), "item_id", "text")


@query
def reply_readers(spark, d):
    t = F.concat(F.when(F.col("turn") % 3 == 0, "Yes, ").when(F.col("turn") % 3 == 1, "no: ").otherwise("yes and no "), F.when(F.col("conv_id") % 2 == 0, "verbal").otherwise("pivot or ambient"))
    raw = F.concat(F.lit("<think>maybe pivot</think> "), t)
    said = text.strip_thinking(raw)
    return _turns(spark, d).select("conv_id", "turn", said.alias("said"), text.read_presence(said).alias("presence"), text.read_reaction(said).alias("reaction"))


@query
def event_names(spark, d):
    event_id = text.event_id(F.col("source"), F.concat_ws("_", "lang", F.lit("bell"), F.col("doc_id").cast("string")))
    return parquet(spark, d, "documents").select("doc_id", text.event_name(event_id).alias("name"), text.pretty(event_id).alias("pretty"))


@query
def safe_ids(spark, d):
    return text.safe_ids(parquet(spark, d, "pages").select("page_id", "url"), "url", "page_id", 24).select("page_id", "safe_id")


@query
def json_props(spark, d):
    return parquet(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def loose_json_reply(spark, d):
    """Replies as models give them: plain, fenced, among words, as Python literals, cut off, empty, or none."""
    i, props = F.col("event_id"), F.col("props")
    k = F.get_json_object("props", "$.k")
    forms = [
        props, F.concat(F.lit("```json\n"), props, F.lit("\n```")), F.concat(F.lit("{'k': "), k, F.lit(", 'ok': True, 'no': None}")), F.concat(F.lit("Sure: {'k': "), k), F.lit("nothing"),
        F.concat(F.lit("Here: "), props, F.lit(" }")), F.lit("  "), F.concat(F.lit("```"), props, F.lit("```")), F.expr("left(props, length(props) - 1)"), F.lit("a [1 or {so on"),
    ]
    rows = parquet(spark, d, "events").select("event_id", read_reply(F.get(F.array(*forms), (i % 10).cast("int"))).alias("r"))
    return rows.select("event_id", F.col("r.status").alias("status"), F.get_json_object("r.value", "$.k").cast("long").alias("k"))


# --- quotas, splits, shards -----------------------------------------------------------------


@query
def compositions30(spark, d):
    """How many scenarios have each composition."""
    found = quota.compositions(spark)
    made = records.distributions(records.normalised(_scenarios(spark, d))).where("kind = 'composition'").select(F.col("value").alias("composition"), F.col("n").alias("scenarios"))
    listed = found.select(*[F.col(c).cast("long").alias(c) if c != "composition" else c for c in found.columns])
    return listed.join(made, "composition", "left").fillna(0, ["scenarios"])


@query
def quota_even(spark, d):
    groups = parquet(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"))
    rows = groups.select("o_orderpriority", "total", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    return rows.select("o_orderpriority", F.col("i").cast("long").alias("i"), quota.even_quota(F.col("total"), 7, F.col("i")).alias("quota"))


@query
def quota_weighted(spark, d):
    groups = parquet(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("weight")).withColumn("total", F.lit(100))
    return quota.largest_remainder(groups, "total", "weight", "source", ("lang",)).select("lang", "source", "quota")


def _split(spark, d):
    docs = parquet(spark, d, "documents").select("doc_id", "lang", "source")
    n = docs.count()
    sizes = quota.parse_sizes(f"{n - 2 * (n // 10)}/{n // 10}/{n // 10}", n)
    return quota.assign_sizes(docs, ["lang", "source"], [quota.hash_order("7", "doc_id"), F.col("doc_id")], sizes)


@query
def stratified_split(spark, d):
    return _split(spark, d)


@query
def file_partition(spark, d):
    files = parquet(spark, d, "documents").select("source", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".wav")).alias("name"))
    return quota.partition_files(files, {"train": 0.9, "dev": 0.05, "test": 0.05}, "source", "name")


@query
def file_partition_sha1(spark, d):
    files = parquet(spark, d, "documents").select("lang", "source", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".wav")).alias("name"))
    return quota.assign_split(files, ["lang", "source"], [quota.hash_order("s", "name"), F.col("name")], {"train": 0.9, "dev": 0.05, "test": 0.05}, each_one=True)


@query
def split_report(spark, d):
    return quota.split_report(_split(spark, d), "source", "lang")


@query
def leak_audit(spark, d):
    found = quota.shared_between_splits(_split(spark, d), "source")
    return found.select("source", F.array_join("splits", ",").alias("splits"))


@query
def pool_check(spark, d):
    return quota.pool_gaps(_split(spark, d).withColumn("pool", F.concat_ws("/", "lang", "source")))


@query
def round_robin_shards(spark, d):
    return quota.round_robin(parquet(spark, d, "pages").select("page_id", "url"), ["page_id", "url"], 4).select("page_id", "shard")


@query
def register_cycle(spark, d):
    return quota.register_cycle(parquet(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"], [quota.hash_order("r", "p_partkey"), F.col("p_partkey")], 7).select("p_partkey", "cycle", "register")


@query
def event_balance(spark, d):
    supplier, flag = F.col("l_suppkey"), F.col("l_returnflag")
    event = F.concat(F.when(supplier % 10 == 7, "rare_events/").when(supplier % 3 == 0, "general/").otherwise("yard/"), supplier)
    rows = parquet(spark, d, "lineitem").select(event.alias("event_id"), F.when(flag == "A", "pivot").when(flag == "N", "verbal").otherwise("ambient").alias("reaction"))
    found = quota.event_balance(rows, "event_id", "reaction")
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.startswith(("mean", "max", "share"))})


@query
def voice_pair(spark, d):
    u = quota.uniform("voice", "conv_id")
    return _turns(spark, d).select("conv_id").distinct().select("conv_id", F.floor(u * 8).cast("long").alias("voice_a"), ((F.floor(u * 8) + 1 + F.floor(quota.uniform("other", "conv_id") * 7)) % 8).cast("long").alias("voice_b"))


# --- catalogue ------------------------------------------------------------------------------


def _catalogue(spark, d):
    region, nation, part, customer = (parquet(spark, d, t) for t in ("region", "nation", "part", "customer"))
    scenes = region.select(F.col("r_name").alias("scene"))
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("scene"), F.col("n_name").alias("event"))
    segments = customer.select("c_mktsegment", (F.length("c_mktsegment") % 5).alias("r_regionkey")).distinct()
    shared = segments.join(region, "r_regionkey").select(F.col("r_name").alias("scene"), F.col("c_mktsegment").alias("event"))
    general = part.select(F.col("p_brand").alias("event")).distinct()
    forbidden = general.select("event", (F.ascii(F.substring("event", -1, 1)) % 5).alias("r_regionkey")).join(region, "r_regionkey").select(F.col("r_name").alias("scene"), "event")
    return own, shared, general, scenes, forbidden


@query
def catalog_pool(spark, d):
    pool = catalog.scene_pool(*_catalogue(spark, d))
    return pool.select("scene", "event", F.col("branch").cast("long").alias("branch"))


@query
def catalog_gaps(spark, d):
    parts = _catalogue(spark, d)
    return catalog.gaps(catalog.scene_pool(*parts), parts[3], 26)


@query
def catalog_unknown(spark, d):
    orders, customers = parquet(spark, d, "orders"), parquet(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return catalog.unknown_references(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), customers, "c_custkey")


@query
def catalog_summary(spark, d):
    own, shared, general, scenes, forbidden = _catalogue(spark, d)
    return catalog.summary(own=own, shared=shared, general=general, scenes=scenes, forbidden=forbidden)


# --- filtering ------------------------------------------------------------------------------


def _steps(spark, d):
    docs = parquet(spark, d, "documents").select("doc_id", "lang", "n_chars")
    ok = docs.where(filtering.accepted((F.col("n_chars") % 100) / 100.0, F.col("doc_id") % 4 != 0, 0.6)).select("doc_id")
    attempts = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 4)).alias("pass"))
    attempts = attempts.withColumn("accepted", (F.col("doc_id") + F.col("pass")) % 3 == 0)
    return docs, ok, attempts


@query
def accept_filter(spark, d):
    docs = parquet(spark, d, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", filtering.accepted((F.col("n_chars") % 100) / 100.0, F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 4 != 0), 0.6).alias("accepted"))


@query
def regen_list(spark, d):
    docs, ok, attempts = _steps(spark, d)
    return filtering.next_steps(docs, ok, attempts, "doc_id", 3).select("doc_id", "n_attempts", "state")


@query
def stratum_acceptance(spark, d):
    docs, ok, attempts = _steps(spark, d)
    first = filtering.first_and_last(attempts, "doc_id", "pass", "accepted").select("doc_id", F.col("first").alias("accepted"))
    return filtering.stratum_acceptance(filtering.next_steps(docs, ok, attempts, "doc_id", 3), first, "doc_id", "lang")


@query
def regeneration_report(spark, d):
    docs, ok, attempts = _steps(spark, d)
    i = F.col("doc_id")
    rows = filtering.next_steps(docs, ok, attempts, "doc_id", 3).withColumn("has_rare", F.when(i % 7 > 0, i % 5 == 0)).withColumn("has_pivot", F.col("lang") == "en")
    last = filtering.first_and_last(attempts.withColumn("n_rescued", F.col("pass") % 2), "doc_id", "pass", "n_rescued").select("doc_id", F.col("last").alias("n_rescued"))
    return filtering.regeneration_report(rows, last, "doc_id")


@query
def inference_metrics(spark, d):
    """Recovery by language and over all; some labels have no evaluation, and in some nothing was heard."""
    i, k = F.col("doc_id"), F.col("doc_id") % 13
    name = lambda c: F.when(F.col(c) == 1, "behavioral").otherwise("ambient")
    first = F.struct(name("quality").alias("gold"), F.when(i % 11 == 0, "missing").otherwise(name("toxic")).alias("pred"))
    second = F.struct(F.lit("pivot").alias("gold"), F.when(i % 2 == 0, "pivot").otherwise("verbal").alias("pred"))
    known = lambda c: F.when(k > 0, c)
    rows = parquet(spark, d, "labels").select(
        "doc_id", F.when((k > 1) & (i % 6 > 0), (i % 10) / 10.0).alias("subject_cos"), known(F.when(k > 1, F.array(first, second)).otherwise(F.slice(F.array(first), 1, 0))).alias("pairs"),
        known(F.lit(2)).alias("n_sounds"), known((i % 11 == 0).cast("long")).alias("n_missing"), known(i % 3).alias("n_spurious"), known((name("quality") == name("toxic")) & (i % 11 > 0) & (i % 2 == 0)).alias("reactions_ok"),
    )
    docs = parquet(spark, d, "documents").select("doc_id", F.explode(F.array("lang", F.lit("all"))).alias("lang"))
    found = filtering.recovery_metrics(filtering.evaluated(docs, rows, "doc_id"), 0.5, text.REACTIONS, ("lang",))
    return found.withColumn("mean_cosine", F.round("mean_cosine", 9))


@query
def attempt_history(spark, d):
    return filtering.first_and_last(_steps(spark, d)[2], "doc_id", "pass", "accepted")


@query
def rescue_rule(spark, d):
    """Behavioural sounds that were heard as ambient, and count where their delivery tags stand right."""
    items_, expected = _dialogue(spark, d)
    at = F.col("conv_id") + F.regexp_extract("event_id", "[0-9]+$", 0).cast("long")
    gold = expected.select("conv_id", "event_id", F.when(at % 4 > 0, "behavioral").otherwise("verbal").alias("gold"))
    predicted = expected.where(at % 11 > 0).select("conv_id", "event_id", F.when(at % 3 > 0, "ambient").otherwise("behavioral").alias("pred"), F.lit(0).alias("ordinal"))
    typed = filtering.typed_events(gold, predicted, ["conv_id", "event_id"]).join(validation.delivery_confirmed(items_, expected, "conv_id"), ["conv_id", "event_id"], "left")
    return filtering.recovery(typed, "conv_id", F.coalesce("confirmed", F.lit(False)))


@query
def cosine_pairs(spark, d):
    found = filtering.near_vectors(parquet(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3)
    return found.withColumn("cosine", F.round("cosine", 6))


@query
def cosine_accept(spark, d):
    rows = parquet(spark, d, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    cos = F.round(filtering.cosine(F.col("embedding"), F.col("e2")), 6)
    return rows.join(other, "vec_id").select("vec_id", cos.alias("cosine"), filtering.accepted(cos, F.lit(True), 0.1).alias("accepted"))


@query
def carried_fields(spark, d):
    docs = parquet(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("lang"), "source")
    scenarios = parquet(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.upper("lang").alias("lang"), F.upper("source").alias("source"))
    return filtering.finish(docs, scenarios, "doc_id", ["lang", "source"])


# --- caches ---------------------------------------------------------------------------------


def _caches(spark, d):
    rows = parquet(spark, d, "events").select("event_id", F.concat_ws("-", "event_type", "user_id").alias("answer"), (F.col("event_id") % 6 == 0).alias("error"))
    late = rows.select("event_id", F.concat(F.col("answer"), F.lit("!")).alias("answer"), (F.col("event_id") % 10 == 0).alias("error"))
    return rows.where("event_id % 3 <> 1"), late.where("event_id % 4 <> 2")


@query
def cache_union(spark, d):
    return cache.merge(list(_caches(spark, d)), "event_id", "error").select("event_id", "answer", "error")


@query
def cache_completeness(spark, d):
    items_, stored = _caches(spark, d)
    return cache.completeness(items_, stored.where("event_id % 8 <> 3 OR error"), "event_id", ["answer"], "error")


@query
def cache_runs(spark, d):
    return cache.run_settings(parquet(spark, d, "events"), "event_type")


@query
def cache_reparse(spark, d):
    rows = _caches(spark, d)[0].withColumn("fresh", F.when(F.col("event_id") % 9 == 0, F.upper("answer")).otherwise(F.col("answer")))
    return cache.reparsed(rows, "fresh", "answer", "error").select("event_id", "answer", "changed")


@query
def resume_pending(spark, d):
    done = parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filtering.pending(parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


@query
def summary_merge(spark, d):
    counts = parquet(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("n"))
    now = counts.where(F.col("task") < "3").withColumn("n", -F.col("n"))
    return merge_summaries(counts, now)


# --- levels and signals ---------------------------------------------------------------------


@query
def distance_level(spark, d):
    metres = F.col("l_quantity").cast("double") / 4
    layer = F.when(F.col("l_returnflag") == "A", "core").when(F.col("l_returnflag") == "R", "rare").otherwise("supporting")
    rows = parquet(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(levels.event_level(layer, metres, F.lit(-34.0)), 6).alias("level"), F.round(levels.lowpass_hz(metres), 6).alias("cutoff"))
    return rows


@query
def duck_limit(spark, d):
    event = F.lit(-30.0) + F.col("l_quantity").cast("double") / 3
    return parquet(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(levels.duck(F.lit(-9.0), event), 6).alias("duck"), levels.margin_bucket(event + 25).alias("bucket"))


@query
def background_jitter(spark, d):
    u = quota.uniform("bg", "conv_id")
    return _turns(spark, d).select("conv_id").distinct().select("conv_id", F.round(levels.jittered(u), 6).alias("lufs"), F.round(levels.tail_pad(u * 90), 6).alias("pad"))


@query
def signal_fade(spark, d):
    faded = signal.faded(8)(F.col("embedding").cast("array<double>"))
    rows = parquet(spark, d, "embeddings").select("vec_id", faded.alias("x"))
    at = [F.round(F.get("x", F.lit(i)) + 0.0, 9).alias(f"x{i}") for i in (0, 1, 4, 7, 30, 57, 63)]
    return rows.select("vec_id", *at, F.round(F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v), 6).alias("weighted"))


@query
def signal_trim(spark, d):
    cut = signal.trimmed(400, -6.0)(F.col("embedding").cast("array<double>"))
    rows = parquet(spark, d, "embeddings").select("vec_id", cut.alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.get("x", F.lit(0)), 9).alias("first"))


# --- streams --------------------------------------------------------------------------------


@query
def streaming_tumbling(spark, d):
    counts = stream_events.tumbling(stream_events.stream(spark, d), "1 day", by=("event_type",))
    return stream_events.run_to_end(counts.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total")), "update", ["event_type", "start"])


@query
def streaming_session(spark, d):
    found = stream_events.sessions(stream_events.stream(spark, d), "6 hours", "user_id")
    return stream_events.run_to_end(found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), "complete", ["user_id", "start"])


# --- records, validation, verdicts ----------------------------------------------------------


def _scenarios(spark, d):
    """A scenario per conversation; its turns are the events."""
    of = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("turn") % len(values)).cast("int"))
    event = F.struct(
        F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat_ws("/", "role", F.concat(F.lit("loud_knock_"), F.col("turn")))).alias("event_id"), of("pivot", "verbal", "behavioral", "ambient").alias("reaction"),
        F.when(F.col("turn") % 2 == 0, F.col("turn") % 5 == 4).alias("is_rare"), of("", "calm").alias("register"), of(*timeline.SLOTS, "").alias("slot"),
    )
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", event.alias("e")))).alias("t"))
    i = F.col("conv_id")
    return rows.select(
        i.cast("string").alias("scenario_id"), (i % 10).cast("string").alias("template_id"), F.lit("c").alias("category"),
        F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("Theme "), i).alias("title"), F.lit("About").alias("description")))).when(i % 3 == 1, F.concat(F.lit("Plain "), i)).alias("theme"),
        F.when(i % 4 == 0, "Template").otherwise("").alias("template_title"), F.lit(None).cast("string").alias("template_description"), F.concat(F.lit("scene_"), i % 4).alias("scene"),
        F.when(i % 2 == 0, F.concat(F.lit(" subject "), i)).alias("subject"), F.struct(F.concat(F.lit("made "), i).alias("subject")).alias("llm_output"),
        F.lit("F").alias("gender_a"), F.lit("M").alias("gender_b"), (i % 10).cast("int").alias("scenario_idx_in_template"),
        F.struct(F.lit("guest").alias("A"), F.when(i % 2 == 0, "host").otherwise("").alias("B")).alias("speakers"), F.when(i % 5 == 0, "clerk").alias("role_a"), F.lit("owner").alias("role_b"),
        F.transform("t", lambda x: x["e"]).alias("events"), F.when(i % 7 == 0, i % 2 == 0).alias("has_rare_event"), F.lit("train").alias("split"),
    )


@query
def canonical_records(spark, d):
    rows = records.normalised(_scenarios(spark, d))
    return rows.select("scenario_id", "theme_title", "theme_description", "theme_label", "subject", "role_a", "role_b", "n_events", "n_reacted_to", "stratum", "has_rare", "has_pivot", "has_rare_event", F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["event_id"], F.coalesce(e["register"], F.lit("-")), F.coalesce(e["slot"], F.lit("-")))), ",").alias("events"))


@query
def record_distributions(spark, d):
    return records.distributions(records.normalised(_scenarios(spark, d)))


def _dialogue(spark, d):
    """Conversations as timelines: every fourth item is an event, other turns are said by A and B; the turn behind an event may carry a tag."""
    t, i = F.col("turn"), F.col("conv_id")
    heard = t % 4 == 3
    tagged = F.concat(F.get(F.array(F.lit(""), F.lit("[gasps] "), F.lit("It stopped. [gasps] "), F.lit("Well... [gasps] "), F.lit("So [Gasps] ")), (i % 5).cast("int")), F.col("text"))
    said = F.when((t % 4 == 0) & (t > 0), tagged).otherwise(F.col("text"))
    items_ = _turns(spark, d).withColumn("text", said).select(
        "conv_id", t.alias("position"), F.when(heard, "event").when(t % 4 == 0, F.lit(None)).otherwise("utterance").alias("type"),
        F.when(~heard, F.when(i % 6 == 5, "A").when(F.col("role") == "user", "A").otherwise("B")).alias("speaker"), F.when(~heard, F.col("text")).alias("text"), F.when(heard, F.concat(F.lit("e/loud_knock_"), t)).alias("event_id"),
    )
    items_ = items_.withColumn("type", records.item_type(*[F.col(c) for c in ("type", "speaker", "text", "event_id")]))
    expected = items_.where("type = 'event'").select("conv_id", "event_id", F.when(i % 3 == 0, "pivot").otherwise("ambient").alias("reaction"), F.when(i % 2 == 0, "early").alias("slot"), F.when(i % 2 == 1, F.array(F.lit("[gasps]"), F.lit("[sighs]"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return items_, expected


@query
def timeline_validation(spark, d):
    items_, expected = _dialogue(spark, d)
    return validation.validated(items_.select("conv_id").distinct(), items_, expected, "conv_id", least=2, most=6, most_words=150)


@query
def inferred_verdicts(spark, d):
    i = F.col("event_id")
    reply = F.when(i % 11 == 0, "[1]").otherwise(F.to_json(F.struct(F.when(i % 7 == 0, "one").otherwise("a subject").alias("subject"), F.array(
        F.struct(F.col("event_type").alias("event_id"), F.when(i % 5 == 0, "loud").otherwise(" Verbal ").alias("reaction")), F.struct(F.lit("click").alias("event_id"), F.lit("pivot").alias("reaction")), F.struct(F.lit("ghost").alias("event_id"), F.lit("ambient").alias("reaction"))).alias("sounds"))))
    rows = parquet(spark, d, "events").select("event_id", verdicts.inferred(reply, F.array("event_type", F.lit("click"))).alias("r"))
    return rows.select("event_id", "r.subject", F.array_join(F.transform("r.predicted", lambda p: F.concat_ws("=", p["event_id"], p["reaction"])), ",").alias("predicted"), F.array_join("r.spurious", ",").alias("spurious"), "r.reason")


@query
def judge_verdicts(spark, d):
    say = lambda sound, verdict, evidence: F.struct(sound.alias("sound"), F.lit(verdict).alias("verdict"), evidence.alias("evidence"))
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    listed = F.to_json(F.array(say(F.lit("bell"), "heard", first), say(F.lit("bell"), "nature", first), say(F.lit("dog"), "nature", F.concat(F.lit("  "), first)), say(F.lit("cat"), "discussed", F.lit("words that nobody said")), say(F.lit("horn"), "heard", first), say(F.lit("dog"), "perhaps", first)))
    rows = _turns(spark, d).select("conv_id", "turn", verdicts.judged(listed, F.array(*[F.lit(n) for n in ("bell", "dog", "cat")]), F.col("text")).alias("v"))
    return rows.select("conv_id", "turn", *[F.array_join(f"v.{c}", ",").alias(c) for c in ("heard", "nature", "discussed", "off_list", "no_evidence")])


def _summaries(spark, d):
    """Three budgets for each conversation, whose texts are the summary; its turns are the sounds, some mentioned."""
    i, t = F.col("conv_id"), F.col("turn")
    name = F.concat(F.lit("s"), t)
    gold = F.struct(name.alias("name"), F.get(F.array(*[F.lit(r) for r in (*text.REACTIONS, "")]), (t % 5).cast("int")).alias("reaction"), (t % 4 == 1).alias("is_rare"))
    rows = _turns(spark, d).withColumn("budget", F.explode(F.array(F.lit(25), F.lit(75), F.lit(200))))
    return rows.groupBy(F.col("conv_id").alias("scenario_id"), "budget").agg(
        F.collect_list(gold).alias("gold"), F.collect_list(F.when((i + t + F.col("budget")) % 3 == 0, name)).alias("mentioned"), F.collect_list(F.when((i + t) % 7 == 0, name)).alias("discussed"), F.when(F.max(i) % 5 > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")).alias("summary"),
    )


@query
def summary_scores(spark, d):
    return verdicts.summary_scores(_summaries(spark, d))


@query
def summary_scores_by_sound(spark, d):
    return verdicts.summary_scores(_summaries(spark, d), by_budget=False, with_rare=False)


@query
def summary_lengths(spark, d):
    return verdicts.summary_lengths(_summaries(spark, d))


def _manifests(spark, d):
    """A manifest per conversation: its turns are nations' events, placed in a region's scene."""
    i, t = F.col("conv_id"), F.col("turn")
    names = parquet(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("x/"), F.col("n_name")).alias("event_id"))
    places = parquet(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r"), F.col("r_name").alias("scene"))
    rows = _turns(spark, d).select("conv_id", "turn", ((i + t) % 25).alias("k"), (i % 6).alias("r")).join(F.broadcast(names), "k").join(F.broadcast(places), "r", "left")
    event = F.struct("turn", "event_id", F.get(F.array(*[F.lit(x) for x in (*text.REACTIONS, "other")]), (t % 5).cast("int")).alias("reaction"), F.when(t % 3 == 0, "rare").otherwise("core").alias("layer"), F.lit(None).cast("string").alias("source_file"), F.lit(False).alias("is_rare"), F.when(t % 6 < 5, -20.0 - t).alias("level_lufs"), (t * 2.0).alias("start_s"))
    return rows.groupBy("conv_id", "scene").agg(F.sort_array(F.collect_list(event)).alias("events_placed")).select("conv_id", "scene", F.lit(-32.0).alias("bed"), "events_placed")


@query
def scene_items(spark, d):
    scenes = _catalogue(spark, d)[3]
    return items.scene_items(_manifests(spark, d), scenes, "conv_id").withColumn("options", F.array_join("options", " / "))


@query
def sound_items(spark, d):
    pool = catalog.scene_pool(*_catalogue(spark, d))
    return items.sound_items(_manifests(spark, d), pool, "conv_id").withColumn("options", F.array_join("options", " / "))


@query
def reaction_items(spark, d):
    return items.reaction_items(_manifests(spark, d), "conv_id")


@query
def gold_sounds(spark, d):
    rows = items.gold_sounds(_manifests(spark, d), "conv_id")
    return rows.select("conv_id", F.explode("gold").alias("g")).select("conv_id", "g.event_id", "g.name", "g.reaction", "g.is_rare", "g.margin_db")


# --- words and tags -------------------------------------------------------------------------


@query
def word_offsets(spark, d):
    """Per turn: words, and sums of their places and lengths."""
    rows = alignment.word_table(_turns(spark, d), "conv_id", "turn", "text").withColumn("offset", F.col("offset").cast("long"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum("offset").alias("places"), F.max("offset").alias("last"), F.sum(F.length("word")).alias("letters"))


@query
def resume_offsets(spark, d):
    """Where turns go on after a break or a pause: words last 0.3 s, with a longer pause behind every seventh; every third turn says its text twice, broken off between."""
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("... "), "text")).otherwise(F.col("text"))
    turns = _turns(spark, d).select("conv_id", "turn", F.lower(text.strip_tags(said)).alias("said"))
    turns = turns.withColumn("starts", alignment.word_starts(F.col("said"))).where("size(starts) > 0")
    word = lambda off, n: F.struct((n * 0.4 + F.floor(n / 7) * 1.3).alias("start"), (n * 0.4 + F.floor(n / 7) * 1.3 + 0.3).alias("end"), off.cast("long").alias("off"))
    turns = turns.withColumn("words", F.transform("starts", word))
    found = timeline.resume_offset(F.col("said"), F.col("words"), F.get("words", F.lit(0))["start"])
    rows = turns.select("conv_id", "turn", found.alias("r"))
    return rows.select("conv_id", "turn", F.round("r.offset", 6).alias("offset"), "r.kind")


@query
def event_tags(spark, d):
    i = F.col("event_id")
    named = F.when(i % 4 == 0, "vocal/Laughter").when(i % 4 == 1, "loud_cough").when(i % 4 == 2, "x/clear_throat").otherwise(F.col("event_type"))
    return parquet(spark, d, "events").select("event_id", tags.event_tag(named).alias("tag"), tags.event_tag(F.concat(F.lit("sfx/gun_"), F.when(i % 2 == 0, "clap").otherwise("x")), effects=True).alias("effect"))


# --- allocation -----------------------------------------------------------------------------


@query
def composition_sequence(spark, d):
    """A composition for each part, those with a pivot twice as often."""
    return allocation.composition_sequence(spark, parquet(spark, d, "part").count(), allocation.parse_boosts("pivot=2")).select("local", "composition")


def _todos(spark, d, *more):
    templates = parquet(spark, d, "part").select("p_partkey", *more)
    region = parquet(spark, d, "region").select(F.col("r_name").alias("scene"))
    relations = parquet(spark, d, "nation").select(F.col("n_name").alias("role_a"), F.lower("n_name").alias("role_b"))
    return allocation.todos(templates, "p_partkey", "p_partkey", region, relations)


@query
def scenario_todos(spark, d):
    """How often every value of every sequence was given to a scenario."""
    rows = _todos(spark, d)
    values = {"scene": "scene", "composition": "composition", "gender": F.concat("gender_a", "gender_b"), "relation": F.greatest(F.lower("role_a"), F.lower("role_b")), "rare": F.when(F.col("has_rare_event"), F.concat(F.lit("with pivot "), F.col("pivot"))).otherwise("no")}
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(v) if isinstance(v, str) else v).alias("value")) for k, v in values.items()]))
    return rows.select(pair.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def _drawn_from(spark, d):
    """Pools of ordinary and rare events per scene."""
    pool = catalog.scene_pool(*_catalogue(spark, d)).select("scene", F.concat(F.when(F.col("branch") == 2, "general/").otherwise(""), "event").alias("event_id"))
    return pool, _catalogue(spark, d)[3].withColumn("event_id", F.explode(F.array(*[F.lit(f"rare_events/{n}") for n in ("thunder", "alarm", "siren")])))


REGISTERS = {"pivot": ["calm", "angry", "afraid"], "verbal": ["terse", "warm"], "behavioral": ["quick"]}


@query
def scenario_events(spark, d):
    found = allocation.events_of_scenarios(allocation.scenario_draws(_todos(spark, d), *_drawn_from(spark, d)), registers=REGISTERS)
    many = lambda test: F.size(F.filter("events", test)).cast("long")
    different = lambda name: F.size(F.array_distinct(F.col("events")[name])).cast("long")
    return found.select("scenario_id", many(lambda e: F.lit(True)).alias("n"), different("event_id").alias("n_different"), many(lambda e: e["reaction"] == "pivot").alias("n_pivot"), many(lambda e: (e["slot"] == "late") & (e["reaction"] == "pivot")).alias("n_late_pivots"), many(lambda e: e["is_rare"]).alias("n_rare"), different("place").alias("n_places"), many(lambda e: e["register"].isNotNull()).alias("n_registers"))


@query
def register_use(spark, d):
    """How often each register was drawn: its reaction's events, dealt out in cycles."""
    found = allocation.scenario_events(allocation.scenario_draws(_todos(spark, d), *_drawn_from(spark, d)), registers=REGISTERS)
    return found.groupBy("reaction", "register").agg(F.count("*").alias("n"))


@query
def balanced_pairing(spark, d):
    """How far events' reactions are from the overall shares, paired as drawn and balanced."""
    rows = _todos(spark, d)
    targets = {r["reaction"]: r["share"] for r in allocation.reaction_targets(rows).collect()}
    draws = kept(allocation.scenario_draws(rows, *_drawn_from(spark, d)), "draws")
    both = [(name, allocation.scenario_events(draws, registers=REGISTERS, targets=own)) for name, own in (("drawn", None), ("balanced", targets))]
    each = [quota.event_balance(kept(found.select("event_id", "reaction"), name), "event_id", "reaction").withColumn("pairing", F.lit(name)) for name, found in both]
    return each[0].unionByName(each[1])


@query
def distance_ranges(spark, d):
    profiles = spark.createDataFrame([("beach/view", 5.0, 60.0), ("rare_events/click", 300.0, 3000.0)], "event_id string, near double, far double")
    i = F.col("event_id")
    rows = parquet(spark, d, "events").select(i.alias("n"), F.concat_ws("/", F.when(i % 3 == 0, "beach").when(i % 3 == 1, "rare_events").otherwise("rural"), "event_type").alias("event_id"), F.when(i % 2 == 0, "office").alias("scene"))
    found = levels.with_distance_range(rows, profiles)
    return found.select("n", "near", "far", F.round(levels.drawn_distance(F.col("near"), F.col("far"), quota.uniform("m", "n")), 6).alias("metres"), F.round(levels.wet_mix(F.lit(0.05), F.col("near")), 9).alias("wet"))


@query
def rare_pool(spark, d):
    _, _, general, scenes, forbidden = _catalogue(spark, d)
    return catalog.allowed_everywhere(general, scenes, forbidden)


@query
def event_layers(spark, d):
    i = F.col("event_id")
    named = F.when(i % 9 == 0, "").otherwise(F.concat(F.when(i % 7 == 0, "rare_events/").otherwise("x/"), "event_type"))
    return parquet(spark, d, "events").select("event_id", quota.layer(named, i % 5 == 0, quota.uniform("layer", "event_id")).alias("layer"))


@query
def spaced_turns(spark, d):
    t, i = F.col("turn"), F.col("conv_id")
    end = F.when((i % 5 == 0) & (t == 1), 0.0).when((i % 7 == 0) & (t == 0), F.lit(None)).otherwise(t * 2.0 + 1.5)
    rows = _turns(spark, d).select("conv_id", "turn", (t * 2.0).alias("start"), end.alias("end"), (i % 3 * 4.0 + 5).alias("length"))
    found = placement.spaced_turns(rows, "conv_id", "turn", "start", "end", "length", 0.2, 0.9)
    return found.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("gap", "new_start", "new_end")])


@query
def spaced_signals(spark, d):
    """Signals cut at their quietest samples near two bounds, with silence put in there."""
    i = F.col("vec_id")
    bounds = F.array((i % 20 + 10).cast("int"), (i % 20 + 30).cast("int"))
    rows = parquet(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), bounds.alias("bounds"))
    rows = rows.withColumn("cuts", signal.cuts_near(6, 50)("x", "bounds")).withColumn("gaps", F.array((i % 4).cast("int"), (i % 7).cast("int")))
    spaced = rows.withColumn("y", placement.with_silence(F.col("x"), F.col("cuts"), F.col("gaps")))
    weighted = F.aggregate(F.zip_with("y", F.sequence(F.lit(1), F.size("y")), lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v)
    return spaced.select("vec_id", *[F.get("cuts", F.lit(k)).cast("long").alias(f"cut{k}") for k in (0, 1)], F.size("y").cast("long").alias("n"), F.round(weighted, 6).alias("weighted"))


@query
def template_faults(spark, d):
    n = F.col("n_nationkey")
    rows = parquet(spark, d, "nation").select("n_regionkey", n.alias("i"), F.when(n % 8 == 3, "Same. ").when(n % 8 == 6, "").otherwise(F.col("n_name")).alias("title"), F.when(n % 11 == 7, "short one").otherwise("a description of some length").alias("description"))
    return validation.template_faults(rows, "n_regionkey", "i", 5)


# --- spoken turns ---------------------------------------------------------------------------


def _words(spark, d):
    tagged = _turns(spark, d).select("conv_id", "turn", F.concat(F.lit("[sighs] "), F.col("text")).alias("text"))
    return alignment.word_table(tagged, "conv_id", "turn", "text")


@query
def word_table(spark, d):
    return _words(spark, d)


@query
def turns_from_words(spark, d):
    """Bounds of turns whose words start where their characters do, 16 a second, one turn a minute."""
    start = F.col("turn") * 60.0 + F.col("offset") / 16
    timed = _words(spark, d).withColumn("start", start).withColumn("end", F.col("start") + F.length("word") / 16)
    lengths = _turns(spark, d).groupBy("conv_id").agg((F.max("turn") * 60.0 + 120).alias("duration")).where("conv_id % 5 > 0")
    return alignment.turns_from_words(timed, lengths, "conv_id", "turn")


@query
def turns_by_source(spark, d):
    i = F.col("conv_id")
    listed = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    meta = listed.where(i % 3 < 2).withColumn("turns", F.when(i % 2 == 0, F.col("turns")).otherwise(F.slice("turns", 1, 0)))
    sources = {"alignment": listed.where(i % 3 == 0), "meta": meta, "plain": listed.where(i % 5 < 4)}
    return alignment.by_source(sources, "conv_id").select("conv_id", "source", F.size("turns").cast("long").alias("n"))


@query
def voices_by_gender(spark, d):
    i = F.col("conv_id")
    pool = parquet(spark, d, "nation").select(F.col("n_name").alias("voice_id"), F.when(F.col("n_nationkey") % 3 == 0, "f").otherwise("m").alias("gender"))
    own = F.when(i % 4 == 1, "f").when(i % 4 == 2, "m").when(i % 4 == 3, "x")
    scenes = _turns(spark, d).select("conv_id").distinct().withColumn("gender_a", own).withColumn("gender_b", F.when(i % 3 == 0, "f").otherwise("m"))
    return alignment.voices_for(scenes, pool, "conv_id")


@query
def speaker_gains(spark, d):
    parts = parquet(spark, d, "events").select("user_id", "event_type", (F.col("value") * F.col("value")).alias("energy"), F.lit(1).alias("n"))
    found = alignment.speaker_gains(parts, "user_id", "event_type", "energy", "n")
    return found.select("user_id", "event_type", F.round("level", 4).alias("level"), F.round("gain", 4).alias("gain"))


@query
def made_again(spark, d):
    """Orders kept when those with a returned item are to be made again."""
    ids = parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filtering.without(parquet(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ids, "o_orderkey")


# --- prompts and placements -----------------------------------------------------------------


def _timelines(spark, d):
    """Conversations as one array of items each: turns of users are said by A, every third turn is an event."""
    t = F.col("turn")
    kind = F.when(t % 3 == 2, "event").when(t % 7 == 6, "pause").otherwise("utterance")
    item = F.struct("turn", kind.alias("type"), F.when(F.col("role") == "user", "A").otherwise("B").alias("speaker"), F.col("text"), F.concat(F.lit("e/knock_"), t % 4).alias("event_id"))
    return _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("timeline"))


@query
def transcripts(spark, d):
    line = F.col("timeline")
    return _timelines(spark, d).select("conv_id", prompts.transcript(line).alias("transcript"), F.array_join(prompts.heard_ids(line), ",").alias("heard"))


@query
def event_prompts(spark, d):
    of = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("turn") % len(values)).cast("int"))
    event = F.struct("turn", F.concat(F.lit("x/hum_"), "turn").alias("event_id"), of("pivot", "verbal", "ambient").alias("reaction"), of(False, None, True).cast("boolean").alias("is_rare"), of("early", "", "late", None).alias("slot"), of("calm", "terse").alias("register"))
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    known = spark.createDataFrame([("pivot", "calm", "stop short", ["[gasps]", "[sighs]"]), ("verbal", "terse", "ask about it", []), ("ambient", "calm", "", ["[coughs]"])], "reaction string, register string, move string, required_tags array<string>")
    lines = prompts.with_event_lines(rows, known, "        move {register}: {move}", "        tags: {tags}")
    task = prompts.filled_in("Pivot {pivot}\n{sounds}\n{lines}", pivot=prompts.pivot_of(F.col("events")), sounds=prompts.bullets(F.transform("events", lambda e: e["event_id"]), 4, "    (none)"), lines=F.col("event_lines"))
    return lines.select("conv_id", F.explode(prompts.messages(F.lit("Write."), task)).alias("m")).select("conv_id", "m.role", "m.content")


@query
def revealed_sounds(spark, d):
    i = F.col("event_id")
    reveal = F.when(i % 3 == 0, "none").when(i % 3 == 1, "time").otherwise("time_id")
    rows = parquet(spark, d, "events")
    said = prompts.revealed(F.when(i % 5 > 0, i / 2.0), F.concat(F.lit("x/soft_"), "event_type"), reveal, "A sound occurs.", "A sound at {t} s.", "A sound at {t} s: {name}.")
    return rows.select("event_id", said.alias("said"), prompts.bullets(F.array("event_type", F.lit("none of them"))).alias("options"))


@query
def listening_clues(spark, d):
    """Replies are the conversations' texts, set against the text before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _turns(spark, d).select("conv_id", "turn", "text", before.alias("before"))
    found = rows.select("conv_id", "turn", prompts.clues(F.col("text"), F.lit("ther_east_hall"), F.array(F.lit("x/answer"), F.lit("x/tion_of"), F.lit("y/ther_that")), F.col("before")).alias("c"))
    return found.select("conv_id", "turn", "c.place", F.array_join("c.sounds", ",").alias("sounds"), F.array_join("c.echoed", ",").alias("echoed"))


@query
def event_placements(spark, d):
    rows = _timelines(spark, d).select("conv_id", F.explode("timeline").alias("i")).select("conv_id", "i.turn", "i.type", "i.event_id")
    i, k = F.col("conv_id"), F.col("k")
    layer = F.when(k == 0, "rare").when(k == 1, "supporting").when(k == 2, F.when(i % 2 == 0, "core").otherwise("supporting"))
    known = rows.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(n) for n in (0, 1, 2, 1)])).alias("k"))
    known = known.select("conv_id", F.concat(F.lit("e/knock_"), k).alias("event_id"), layer.alias("layer"), F.when(k == 1, "verbal").alias("reaction"), (i % 3 == k).alias("behavioural"))
    return placement.event_placements(rows, known, "conv_id", "turn")


@query
def shard_sizes(spark, d):
    """Orders over seven shards, two of which stay empty."""
    return quota.shard_sizes(parquet(spark, d, "orders").select((F.col("o_orderkey") % 6).cast("long").alias("shard")).where("shard <> 3"), 7)


@query
def signal_rare_duck(spark, d):
    ends = F.array(F.lit(0.05), F.lit(0.5), F.lit(9.0))
    low = signal.ducked_after(40)(F.col("embedding").cast("array<double>"), ends)
    weighted = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    rows = parquet(spark, d, "embeddings").select("vec_id", low.alias("x"))
    return rows.select("vec_id", *[F.round(F.get("x", F.lit(i)) + 0.0, 9).alias(f"x{i}") for i in (1, 2, 3, 30, 50, 63)], F.round(weighted, 6).alias("weighted"))


@query
def audio_formats(spark, d):
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 3 == 0, "mp3").when(p % 3 == 1, "pcm").otherwise("opus"), F.lit("_"), F.when(p % 4 > 0, (p % 5 + 1) * 8000).cast("string"), F.when(p % 2 == 0, "_128").otherwise(""))
    name = F.coalesce(name, F.lit("mp3_high_64"))
    return parquet(spark, d, "part").select("p_partkey", signal.mp3_bitrate(name).alias("bitrate"), signal.sample_rate(name).alias("rate"), F.round(signal.pcm_seconds(p * 1000, F.lit(44100)), 6).alias("seconds"))


# --- finished records -----------------------------------------------------------------------


@query
def final_dialogues(spark, d):
    told = _timelines(spark, d).where("conv_id % 9 > 0").select(F.col("conv_id").cast("string").alias("scenario_id"), "timeline")
    rows = assembly.final_dialogues(records.normalised(_scenarios(spark, d)), told)
    whole = F.md5(F.array_join(F.transform("timeline", lambda i: F.coalesce(i["text"], F.lit(""))), "|").cast("binary"))
    return rows.select("scenario_id", "scene", "split", "gender_a", "n_events", "n_turns_total", "n_turns_a", "n_turns_b", "n_events_in_timeline", whole.alias("texts"), F.array_join(F.transform("timeline", lambda i: i["type"]), ",").alias("types"))


@query
def batch_results(spark, d):
    o = parquet(spark, d, "orders")
    custom = F.concat(F.lit("c"), "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "errored").otherwise("expired")
    found = o.select(custom.alias("custom_id"), kind.alias("kind"), F.col("o_orderpriority").alias("reply"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("error_type"), F.concat(F.lit("{'param': '"), "o_orderstatus", F.lit("'}")).alias("error"))
    sent = o.where("o_orderkey % 4 > 0").select(custom.alias("custom_id"), F.col("o_orderkey").cast("string").alias("item_id"))
    return assembly.batch_results(found, sent).select("item_id", "status", "reply", assembly.rejected_parameter(F.col("note")).alias("parameter"))


@query
def master_levels(spark, d):
    rows = parquet(spark, d, "part").select(F.col("p_partkey").alias("scenario_id"))
    p = F.col("scenario_id")
    kept = rows.where(p % 3 > 0).select("scenario_id", F.when(p % 2 == 0, F.to_json(F.struct((p / -8).alias("master_input_lufs"), F.lit("none").alias("master_limiter_gain")))).otherwise(F.to_json(F.struct(F.lit(1).alias("master_limiter_gain")))).alias("processing"))
    files = rows.where(p % 5 == 0).select(F.concat(F.lit("/a/"), p, F.lit(".mp3")).alias("path"))
    declared = rows.select("scenario_id", F.concat(F.lit("/a/"), p, F.lit(".mp3")).alias("audio"))
    return assembly.master_levels(assembly.declared_audio(declared, files, "/scenes").select("scenario_id", "path"), kept)


@query
def strengthened_turns(spark, d):
    """Texts with delivery tags of all kinds in front, in between and behind."""
    t, said = F.col("turn") % 6, F.col("text")
    tagged = F.when(t == 0, F.concat(F.lit("[slightly annoyed] "), said)).when(t == 1, F.concat(F.lit("[loudly] "), said)).when(t == 2, F.concat(said, F.lit(" [a bit] now")))
    tagged = tagged.when(t == 3, F.concat(F.lit("Wait [shouting, angry] "), said)).when(t == 4, F.concat(said, F.lit(" [laughs] Yes [softer]"))).otherwise(said)
    return _turns(spark, d).select("conv_id", "turn", tags.strengthened(tagged).alias("said"))


@query
def timeline_items(spark, d):
    rows = records.turn_rows(_timelines(spark, d).withColumn("timeline", F.transform("timeline", lambda i: F.struct(F.when(i["turn"] % 5 > 0, i["type"]).alias("type"), F.when(i["type"] != "event", i["speaker"]).alias("speaker"), F.when(i["type"] != "event", i["text"]).alias("text"), F.when(i["type"] == "event", i["event_id"]).alias("event_id")))), "conv_id")
    return rows.groupBy("conv_id", "type").agg(F.count("*").alias("n"), F.count("speaker").alias("n_spoken"), F.sum(F.length("text")).alias("letters"), F.max("position").cast("long").alias("last"))


# --- lists, stores, streams of attempts -----------------------------------------------------


@query
def request_batches(spark, d):
    """Orders packed in the order of their keys into batches of at most 40 of them and 60,000 bytes; a few are larger than that."""
    key = F.col("o_orderkey")
    size = F.when(key % 501 == 0, 1_000_000).otherwise(F.col("o_custkey") % 97 * 40 + key % 13)
    rows = batches.batched(parquet(spark, d, "orders").select("o_orderkey", size.alias("bytes")), ["o_orderkey"], "bytes", 40, 60_000)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query
def stored_passes(spark, d):
    """Orders stored in three passes, the later over the earlier; invalid ones dropped, the store compacted, and what is still to do."""
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_totalprice")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    store = KeyedStore(spark, scratch(spark, "store"), "o_orderkey", "o_orderkey long, price double, pass string", 16)
    for name, own, value in (("one", key % 4 < 3, price), ("two", key % 3 == 0, price * 2), ("three", key % 5 == 0, -price)):
        store.record(orders.where(own).select("o_orderkey", value.alias("price"), F.lit(name).alias("pass")))
    store.drop(F.col("price") >= 0)
    store.compact()
    left = store.pending(orders, F.col("pass") != "one").select("o_orderkey", F.lit(True).alias("pending"))
    return orders.select("o_orderkey").join(store.rows(), "o_orderkey", "left").join(left, "o_orderkey", "left").fillna(False, ["pending"])


@query
def streaming_attempts(spark, d):
    """Attempts at every document as a stream: which documents are accepted, abandoned or to be made again."""
    docs = spark.readStream.schema("doc_id long").parquet(f"{d}/documents*.parquet")
    attempts = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 4)).alias("pass"))
    states = stream_attempts.attempt_states(attempts.withColumn("accepted", (F.col("doc_id") + F.col("pass")) % 3 == 0), "doc_id", "accepted", 3)
    return stream_events.run_to_end(states, "update", ["doc_id"])


# --- files and times ------------------------------------------------------------------------


@query
def event_takes(spark, d):
    """A file of the right pool and split for every turn: a conversation's pool is that of the document of its number."""
    docs = parquet(spark, d, "documents").select("doc_id", "lang", "source")
    pool = F.concat_ws("/", "lang", "source")
    files = docs.select("lang", "source", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".wav")).alias("name"))
    files = quota.assign_split(files, ["lang", "source"], [quota.hash_order("s", "name"), F.col("name")], {"train": 0.9, "dev": 0.05, "test": 0.05}, each_one=True).select(pool.alias("pool"), "split", "name")
    split = F.get(F.array(F.lit("train"), F.lit("dev"), F.lit("test"), F.lit("")), (F.col("turn") % 4).cast("int"))
    turns = _turns(spark, d).join(docs.select(F.col("doc_id").alias("conv_id"), pool.alias("pool")), "conv_id", "left").withColumn("k", F.concat_ws("-", "conv_id", "turn"))
    return catalog.takes(turns.select("conv_id", "turn", "k", "pool", split.alias("split")), files, "k").select("conv_id", "turn", "pool", "split", "name")


@query
def alignment_forms(spark, d):
    """Alignment files as several tools write them, read as one."""
    i, t = F.col("conv_id"), F.col("turn")
    form, start, end = i % 5, t * 2.0, t * 2.0 + 1.5
    turn = F.struct(
        "turn", F.when(form == 0, F.col("role")).alias("speaker"), F.when(form == 0, start).alias("start_s"), F.when(form == 0, end).alias("end_s"), F.when(form == 1, F.col("role")).alias("spk"), F.when(form == 1, start).alias("t_start"), F.when(form == 1, end).alias("t_end"),
        F.when(form == 2, F.col("role")).alias("voice_id"), F.when(form == 2, end).alias("end_time_seconds"), F.when(form == 2, start).alias("start_time_seconds"), F.when(form == 4, F.col("role")).alias("speaker_label"), F.when(form == 4, start.cast("string")).alias("start"),
    )
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    told = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    none = F.slice("t", 1, 0)
    raw = F.when(form == 0, told(F.struct(F.col("t").alias("turns"), none.alias("turns_meta")))).when(form == 1, told(F.struct(none.alias("turns"), F.col("t").alias("turns_meta"))))
    raw = raw.when(form == 2, told(F.col("t"))).when(form == 3, F.concat(F.lit("x"), told(F.col("t")))).otherwise(told(F.struct(F.lit(7).alias("turns"), F.col("t").alias("turns_meta"))))
    found = rows.select("conv_id", alignment.read_turns(raw).alias("turns"))
    total = lambda f: F.aggregate("turns", F.lit(0.0), lambda a, x: a + F.coalesce(x[f], F.lit(0.0)))
    return found.select("conv_id", F.when(F.col("turns").isNotNull(), F.size("turns")).cast("long").alias("n"), F.array_join(F.transform("turns", lambda x: x["speaker"]), ",").alias("speakers"), total("start").alias("starts"), total("end").alias("ends"), alignment.is_timed(F.col("turns")).alias("timed"))


@query
def turn_overlaps(spark, d):
    """Seconds that turns and events share: a user's turns take a second per four characters, an event a minute per unit of its value."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    heard = parquet(spark, d, "events").select(F.col("user_id").alias("user"), "event_id", seconds.alias("b_start"), (seconds + F.col("value") * 60).alias("b_end"))
    begin = (F.col("conv_id") * 7919 + F.col("turn") * 86_400) % 2_592_000
    turns = _turns(spark, d).select((F.col("conv_id") % 150).alias("user"), "conv_id", "turn", begin.cast("double").alias("a_start"), (begin + F.length("text") / 4.0 * F.when(F.col("turn") == 2, 500).otherwise(1)).alias("a_end"))
    return placement.overlaps(turns, heard, "user", 60.0).select("event_id", "conv_id", "turn", F.round("shared", 4).alias("shared"))


# --- shapes of signals and rooms ------------------------------------------------------------


@query
def signal_shapes(spark, d):
    """What the helpers of mixing make of each signal: sums weighted by place, lengths, places and levels."""
    x = F.col("x")
    rows = parquet(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    weighted = lambda y: F.round(F.aggregate(F.zip_with(y, F.sequence(F.lit(1), F.size(y)), lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v), 6)
    made = rows.withColumns({
        "released": signal.shaped(lambda s: signal.release(s, 8))(x), "looped": signal.shaped(lambda s: signal.loop_or_cut(s, 100, 10))(x), "cut": signal.shaped(lambda s: signal.cut_overlap(s, 40, 8))(x),
        "ducked": signal.shaped(lambda s: s * signal.duck_envelope(len(s), 40, -6.0, 10))(x), "aligned": signal.shaped(lambda s: signal.aligned(s, 200))(x), "window": signal.drawn_window(20, 5, 4)(x, quota.uniform("cut", "vec_id")),
        "loudest": signal.number(lambda s: signal.loudest_window(s, 10))(x), "limit": signal.number(lambda s: signal.limiter_gain(s, -10.0))(x), "tail": signal.number(lambda s: signal.tail_level(s, 200))(x),
    })
    return made.select("vec_id", *[weighted(F.col(c)).alias(c) for c in ("released", "looped", "cut", "ducked", "window")], F.size("aligned").cast("long").alias("aligned"), F.col("loudest").cast("long").alias("loudest"), F.round("limit", 9).alias("limit"), F.round("tail", 6).alias("tail"))


@query
def room_shapes(spark, d):
    """How rooms vary between splits, and distances that reactions bring nearer."""
    i, t = F.col("conv_id"), F.col("turn")
    split = F.get(F.array(F.lit("train"), F.lit("dev"), F.lit("")), (i % 4).cast("int"))
    rows = _turns(spark, d).select("conv_id", "turn", F.concat(F.lit("scene_"), i % 5).alias("scene"), split.alias("split"), F.get(F.array(*[F.lit(r) for r in text.REACTIONS]), (t % 5).cast("int")).alias("reaction"))
    bias = levels.by_reaction(F.col("reaction"), {"pivot": 0.25, "verbal": 0.5, "ambient": 3.0})
    metres = levels.drawn_distance(F.lit(2.0), F.lit(42.0), quota.uniform("m", "conv_id", "turn"), bias)
    return rows.withColumn("room", levels.room_variation("scene", "split")).select("conv_id", "turn", *[F.round(F.get("room", F.lit(k)), 9).alias(f"room{k}") for k in range(3)], F.round(metres, 6).alias("metres"))


# --- replies, ids and plans -----------------------------------------------------------------


@query
def generated_subjects(spark, d):
    """Subjects of 0 to 70 words out of replies that repeat the prompt's end, and what is wrong with them."""
    said = F.array_join(F.slice(text.words(F.col("text")), F.lit(1), ((F.col("conv_id") * 7 + F.col("turn") * 11) % 71).cast("int")), " ")
    prompt = F.concat(F.lit("Describe scene "), F.col("conv_id"), F.lit(" in your own words, without naming any of its sounds:"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<s>"), prompt, F.lit("\n "), said)).otherwise(said)
    rows = _turns(spark, d).select("conv_id", "turn", text.after_prompt(raw, prompt).alias("subject"))
    return rows.select("conv_id", "turn", F.md5(F.col("subject").cast("binary")).alias("digest"), text.subject_fault(F.col("subject")).alias("fault"))


@query
def reply_lists(spark, d):
    """Lists in replies: the root, under a known name, under the only name that has one, or none that is sure."""
    i, props = F.col("event_id"), F.col("props")
    one = F.concat(F.lit("["), props, F.lit("]"))
    forms = [one, F.concat(F.lit('{"n": 1, "items": '), one, F.lit("}")), F.concat(F.lit('{"other": '), one, F.lit(', "text": "[1]x"}')), F.concat(F.lit('{"a": '), one, F.lit(', "b": [2]}')), F.concat(F.lit('{"a": [0], "list": '), one, F.lit("}")), props]
    found = list_in(F.get(F.array(*forms), (i % 6).cast("int")), ("items", "list"))
    return parquet(spark, d, "events").select("event_id", F.get_json_object(found, "$[0].k").cast("long").alias("k"))


@query
def reply_values(spark, d):
    """Answers out of replies' values: objects with one of several names, plain strings and others."""
    k = F.col("p_partkey")
    present = F.when(k % 4 == 0, '{"present": true}').when(k % 4 == 1, '{"x": 1, "answer": " No "}').when(k % 4 == 2, '"oui"').otherwise('{"present": null, "answer": "yes"}')
    reaction = F.when(k % 3 == 0, F.concat(F.lit('{"reaction": "'), F.upper(F.get(F.array(*[F.lit(r) for r in text.REACTIONS]), (k % 4).cast("int"))), F.lit('"}'))).when(k % 3 == 1, '"verbal "').otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    return parquet(spark, d, "part").select("p_partkey", text.presence_of(present).alias("presence"), text.reaction_of(reaction).alias("reaction"))


@query
def behavioural_events(spark, d):
    """Events that dialogues' records say a person makes, in lists and timelines, under several names."""
    i, t = F.col("conv_id"), F.col("turn")
    named = F.concat(F.lit("e"), t)
    event = F.struct(
        "turn", F.when(t % 3 == 0, named).alias("event_id"), F.when(t % 3 == 1, named).alias("id"), F.when(t % 3 == 2, named).alias("sound_id"), F.when(t % 4 == 0, " Behavioural ").when(t % 4 == 1, "verbal").alias("nature"),
        F.when(t % 4 == 2, True).alias("is_behavioral"), F.when(t % 4 == 3, "true").alias("behavioral"), F.when((i + t) % 2 == 0, "event").otherwise("utterance").alias("type"),
    )
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("t"))
    record = F.when(i % 4 == 0, F.to_json(F.struct(F.col("t").alias("core_elements"), F.lit("x").alias("my_elements")))).when(i % 4 == 1, F.to_json(F.struct(F.col("t").alias("events"), F.col("t").alias("elements"))))
    record = record.when(i % 4 == 2, F.to_json(F.struct(F.col("t").alias("timeline"), F.col("t").alias("others")))).otherwise(F.lit("{cut"))
    return rows.select("conv_id", F.array_join(placement.behavioural_ids(record), ",").alias("ids"))


@query
def speakers_across(spark, d):
    rows = _turns(spark, d).withColumn("speaker", F.when(F.col("conv_id") % 3 > 0, F.when(F.col("turn") % 5 < 3, F.col("role"))))
    return placement.same_speaker_across(rows, "conv_id", "turn", "speaker").select("conv_id", "turn", "same_across")


@query
def unvoiced_events(spark, d):
    """Events that stay to be placed when voices perform some of them; some voices were planned only, or tell nothing."""
    i, t = F.col("conv_id"), F.col("turn")
    events = _turns(spark, d).select("conv_id", "turn", F.concat(F.lit("e"), t).alias("event_id"))
    done = F.collect_list(F.when(t % 3 == 0, F.struct(F.concat(F.lit("e"), t).alias("event_id"))))
    voices = _turns(spark, d).groupBy("conv_id").agg(done.alias("done"))
    meta = F.when(i % 4 == 0, F.to_json(F.struct(F.col("done").alias("events_rendered_as_tags")))).when(i % 4 == 1, F.to_json(F.struct(F.col("done").alias("events_rendered_as_tags"), F.lit(True).alias("dry_run")))).when(i % 4 == 2, '{"events_rendered_as_tags": 5}').otherwise("[]")
    voices = voices.select("conv_id", meta.alias("meta"))
    left = placement.not_voiced(events, voices, "conv_id")
    return left.join(voices.select("conv_id", placement.is_synthesized(F.col("meta")).alias("made")), "conv_id", "left").select("conv_id", "turn", "made")


@query
def synthesis_plans(spark, d):
    rows = timeline.synthesis_plans(_turns(spark, d), "conv_id", "turn", "text", 2000)
    return rows.withColumn("chunk_ranges", F.array_join(F.transform("chunk_ranges", lambda r: F.array_join(r.cast("array<string>"), "-")), ","))


# --- reports --------------------------------------------------------------------------------


@query
def cache_verdicts(spark, d):
    """Whether each task's cache may be used: events are the items, their types the tasks."""
    i = F.col("event_id")
    rows = parquet(spark, d, "events").select("event_type", "event_id", F.concat_ws("-", "event_type", "user_id").alias("answer"))
    task = F.concat(F.col("event_type"), F.when(i % 2 == 0, "-a").otherwise("-b"))
    rows = rows.select(task.alias("task"), "event_id", "answer", "event_type")
    settings = F.create_map(F.lit("model"), F.when((F.col("event_type") == "view") & (i % 10 == 2), "other").otherwise("one"), F.lit("seed"), F.lit("7"))
    held = rows.where(~((F.col("event_type") == "click") & (i % 11 == 0)) & (F.col("task") != "error-a")).withColumn("error", (F.col("task") == "purchase-b") & (i % 9 == 0)).withColumn("run", F.when(i % 5 > 0, settings))
    held = held.withColumn("answer", F.when((F.col("task") == "purchase-a") & (i % 7 == 0), "?").otherwise(F.col("answer")))
    return cache.task_verdicts(rows.drop("event_type"), held.drop("event_type"), "task", "event_id", ["answer"], "error", "run")


@query
def summary_mentions(spark, d):
    return verdicts.mention_rates(_summaries(spark, d))


@query
def summary_mentions_over_budgets(spark, d):
    return verdicts.mentions_over_budgets(_summaries(spark, d))


@query
def judged_summaries(spark, d):
    """Items of the summary task with their gold sounds and what a judge said of the conversation's text."""
    gold = items.gold_sounds(_manifests(spark, d), "conv_id")
    rows = items.summary_items(gold, "conv_id").join(_turns(spark, d).where("turn = 0").select("conv_id", F.col("text").alias("summary")), "conv_id", "left")
    first = F.array_join(F.slice(F.split("summary", " "), 1, 3), " ")
    said = F.transform("gold", lambda g, k: F.struct(g["name"].alias("sound"), F.when(k % 3 == 0, "heard").when(k % 3 == 1, "nature").otherwise("discussed").alias("verdict"), F.when(k % 2 == 0, first).otherwise("nobody said so").alias("evidence")))
    told = rows.where("budget <> 75").select("item_id", F.to_json(said).alias("verdicts"))
    found = verdicts.judged_summaries(rows, told)
    return found.select("item_id", F.size("gold").cast("long").alias("n_gold"), *[F.array_join(f"judged.{c}", ",").alias(c) for c in ("heard", "nature", "discussed", "no_evidence")])


@query
def dataset_split_report(spark, d):
    """Scenarios of templates that have a split: what each split holds."""
    split = F.when(F.col("p_size") % 10 < 8, "train").when(F.col("p_size") % 10 == 8, "dev").otherwise("test")
    rows = _todos(spark, d, F.col("p_brand").alias("theme"), split.alias("split")).withColumnRenamed("p_partkey", "template_id")
    each = F.flatten(F.array(*[F.array_repeat(F.lit(k), F.col(k).cast("int")) for k in allocation.KINDS]))
    found = quota.dataset_split_report(records.restricted(rows, ("train", "test")), rows.select("scenario_id", F.explode(each).alias("reaction")))
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.startswith("share")})


@query
def source_audit(spark, d):
    """Files that scenes of several splits use; a conversation is a scene, its turns' texts choose the files."""
    i, t = F.col("conv_id"), F.col("turn")
    event = F.struct("turn", F.when(t % 4 > 0, F.concat(F.lit("take"), F.length("text") % 23)).otherwise("").alias("source_file"))
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("events_placed"))
    rows = rows.select("events_placed", F.when(i % 3 > 0, F.concat(F.lit("bed"), i % 7)).alias("background_source"), F.get(F.array(F.lit("train"), F.lit("dev"), F.lit("train"), F.lit(""), F.lit("test")), (i % 6).cast("int")).alias("split"))
    return quota.audited_sources(rows).withColumn("splits", F.array_join("splits", ","))


@query
def rare_exclusions(spark, d):
    """Exclusions of brands in regions that name brands or regions unknown to the catalogue."""
    part, region = parquet(spark, d, "part"), parquet(spark, d, "region")
    rows = part.select(F.when(F.col("p_partkey") % 40 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("event"), (F.col("p_partkey") % 6).alias("r")).distinct()
    named = rows.join(region.select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("scene")), "r", "left").select("event", F.coalesce("scene", F.lit("MOON")).alias("scene"))
    return catalog.rare_faults(named, part.select(F.col("p_brand").alias("event")).distinct(), region.select(F.col("r_name").alias("scene")))


# --- finished tables ------------------------------------------------------------------------


@query
def layer_sets(spark, d):
    """Events of dialogues by layer, with elements of two other lists."""
    i, t = F.col("conv_id"), F.col("turn")
    named = F.when(t % 7 == 6, "").otherwise(F.concat(F.when(t % 5 == 4, "rare_events/").otherwise("x/"), F.lit("e"), (i + t) % 6))
    events = F.collect_list(F.when(t % 2 == 0, F.struct(named.alias("event_id"), (t % 9 == 8).alias("is_rare"))))
    element = lambda k: F.collect_list(F.when(t % 4 == k, F.struct(F.concat(F.when(t % 3 == 0, "rare_events/").otherwise("x/"), F.lit("e"), t % 8).alias("event_id"), F.when(i % 4 > 0, "acoustic_event").alias("nature"))))
    rows = _turns(spark, d).groupBy("conv_id").agg(events.alias("events"), element(1).alias("core_elements"), element(3).alias("supporting_elements"))
    found = quota.layer_sets(rows, "conv_id")
    return found.select("conv_id", *[F.array_join(c, ",").alias(c) for c in ("core", "supporting", "rare")])


@query
def flat_templates(spark, d):
    """Parts as the templates of their brands and types."""
    rows = parquet(spark, d, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("theme")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("title"), F.col("p_size").cast("string").alias("description")))).alias("templates"))
    return records.flat_templates(rows).withColumn("index", F.col("index").cast("long"))


@query
def finished_dataset(spark, d):
    i = F.col("conv_id")
    told = _timelines(spark, d).where(i % 4 < 3).select(i.cast("string").alias("scenario_id"), "timeline", F.when(i % 3 == 0, F.concat(F.lit("own "), i)).when(i % 3 == 1, "").alias("category"), F.when(i % 5 == 0, "dev").alias("split"), F.when(i % 6 == 0, '{"title": "My title"}').alias("theme"), F.lit("m").alias("metadata"))
    normal = records.normalised(_scenarios(spark, d)).where("cast(scenario_id AS long) % 7 > 0").drop("theme_label").withColumn("theme", F.col("theme_title"))
    found = assembly.finished_dataset(told, normal)
    return found.select("scenario_id", "scene", "subject", "has_rare_event", F.size("timeline").cast("long").alias("n"), *assembly.CARRIED)


@query
def pending_subjects(spark, d):
    """Scenes whose stored subject can't be used, or that have none: they are generated again."""
    said = F.array_join(F.slice(text.words(F.col("text")), F.lit(1), ((F.col("conv_id") * 5) % 67).cast("int")), " ")
    stored = _turns(spark, d).where("turn = 1").select("conv_id", said.alias("subject"))
    return filtering.pending(_turns(spark, d).select("conv_id").distinct(), stored.where(text.subject_fault(F.col("subject")).isNull()), "conv_id")


@query
def pending_dialogues(spark, d):
    """Scenes whose stored dialogue no longer passes validation."""
    items_, expected = _dialogue(spark, d)
    scenes = items_.select("conv_id").distinct()
    valid = validation.validated(scenes, items_, expected, "conv_id", least=2, most=6, most_words=150).where("valid")
    return filtering.pending(scenes, valid, "conv_id")
