"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import domains, schemas, session
from ..functions import rules, text, vectors
from ..operators import (
    asking, board, browse, chunking, embedding, folds, insight, merge, people, prepare, quality,
    runlog, search, states,
)
from ..sources import feeds
from ..sources.tables import dealt, spread
from . import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYWORDS = ["The", "und", "la"]
TERMS = ("the", "of", "und", "la", "der", "que", "tion", "java")
RISK_TERMS = {"label the": "the ", "label und": "und", "label que": "que", "label tion": "tion"}
AS_OF = "1998-01-01"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(session.configure(spark), sf)

    QUERIES[fn.__name__] = run
    return fn


def _iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: text.iso_text(c) for c in columns})


# ---- preparation -----------------------------------------------------------------

@query
def prepare_postings(spark, sf):
    ready = prepare.prepare(bridge.resent_postings(spark, sf), ["landing", "ingest_seq"])
    return _as_text(ready, "remote").select(
        "id", "source", "title", "company", "location", "remote", "salary_max",
        F.length("description_text").alias("n_chars"), "content_hash", "posted_at")


@query
def prepare_metrics(spark, sf):
    return prepare.prepare_metrics(bridge.resent_postings(spark, sf))


@query
def reject_reasons(spark, sf):
    return prepare.rejected(bridge.resent_postings(spark, sf)).groupBy(
        "source", "reject_reason").agg(F.count("*").alias("rejected_rows"))


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Columns that may be NULL and have no NULL in every reader's table type."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _normalized(df: DataFrame) -> DataFrame:
    return _iso(df, "posted_at").select(
        "id", "source", "external_id", "title", "company", "location", "remote",
        "salary_min", "salary_max", "salary_currency", "employment_type", "category",
        text.content_hash(F.coalesce("description_text", F.lit(""))).alias("content_hash"),
        "apply_url", "posted_at", "reject_reason")


@query
def normalize_source_a(spark, sf):
    return _normalized(feeds.normalize_a(bridge.feed_a(spark, sf)))


@query
def normalize_source_b(spark, sf):
    return _normalized(feeds.normalize_b(bridge.feed_b(spark, sf)))


@query
def normalize_source_c(spark, sf):
    return _normalized(feeds.normalize_c(bridge.feed_c(spark, sf)))


@query
def typed_postings(spark, sf):
    rows = bridge.raw_postings(spark, sf).drop("payload_json", "company").withColumns({
        "salary_min": F.col("salary_min").cast("string"),
        "payload": F.struct(F.col("ingest_seq").alias("n"), F.struct("source", "location")
                            .alias("at"))})
    typed = _as_text(_iso(feeds.typed(rows), "posted_at"), "remote")
    return typed.withColumn("description_text", text.content_hash("description_text"))


@query
def html_to_text(spark, sf):
    pages = bridge.spread(bridge.table(spark, sf, "pages"), "page_id")
    body = text.html_text("html")
    return pages.select("page_id", body.alias("body")).select(
        "page_id", "body", text.words("body").alias("n_words"))


def _harvest(spark, sf) -> DataFrame:
    """All three feeds, each sent twice."""
    frames = []
    for landing in (0, 1):
        for rank, frame in enumerate((
                feeds.normalize_a(bridge.feed_a(spark, sf)),
                feeds.normalize_b(bridge.feed_b(spark, sf)),
                feeds.normalize_c(bridge.feed_c(spark, sf)))):
            frames.append(feeds.usable(frame).withColumns({
                "landing": F.lit(landing), "source_rank": F.lit(rank)}))
    return prepare.harvest(frames, ["landing", "source_rank", "ingest_seq"])


@query
def harvest_summary(spark, sf):
    return board.source_counts(_harvest(spark, sf))


@query
def keyword_filter_capped(spark, sf):
    raw = bridge.raw_postings(spark, sf).withColumn("tags", F.array("location"))
    wanted = raw.filter(prepare.matches_keywords(KEYWORDS))
    cap = prepare.source_cap(5, len(KEYWORDS))
    return prepare.cap_per_source(wanted, cap, [F.col("ingest_seq")]).select(
        "id", "source", "feed_rank")


@query
def source_side_filters(spark, sf):
    found = feeds.source_filters(
        bridge.raw_postings(spark, sf), keyword="Tion", location="e",
        as_of=bridge.as_of("2024-01-31"), max_days_old=25, salary_min=5000.0,
        full_time=True, remote=True)
    return found.select("id", "location", "salary_max", "employment_type", "posted_at")


@query
def source_page(spark, sf):
    """The second page of a feed, asked for by where the first one ended."""
    rows = bridge.raw_postings(spark, sf).select("id", "ingest_seq", "title")
    return feeds.page(rows, 100, after=(99, "src19:99"))


@query
def query_list_parse(spark, sf):
    parts = bridge.table(spark, sf, "part").select(F.concat_ws(
        ";", F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lit("  "), "p_type", "p_name",
    ).alias("list"))
    return feeds.parse_queries(parts, "list", "Berlin").groupBy(
        "keyword", "location").agg(F.count("*").alias("entries"))


# ---- browsing --------------------------------------------------------------------

@query
def browse_filters(spark, sf):
    condition = (
        browse.in_sources([f"SRC{i}" for i in range(10)]) & browse.is_remote()
        & browse.salary_at_least(2000.0) & browse.place_like("E"))
    return browse.browse(bridge.postings(spark, sf), condition, 50)


@query
def browse_preferences(spark, sf):
    """The preference predicates for one profile, without limit."""
    condition = (
        browse.remote_fits("onsite") & browse.salary_not_below(3000.0)
        & browse.title_matches(["und", "la"]) & browse.place_fits(["DE", " "]))
    return browse.shown(bridge.postings(spark, sf).filter(condition)).select(
        "id", "location", "remote", "salary_max", "description_preview")


@query
def relevant_postings_per_profile(spark, sf):
    found = browse.relevant_postings(
        browse.default_profiles(bridge.profiles(spark, sf), required=True),
        bridge.postings(spark, sf), 25)
    return _as_text(found, "remote").select(
        "profile_id", "rank", "id", "location", "remote", "salary_max", "posted_at")


@query
def profile_search_context(spark, sf):
    asked = bridge.profiles(spark, sf).select(
        F.col("id").alias("request_id"),
        F.concat(F.lit("  work\tfor "), "user_id").alias("query"),
        (F.col("salary_min") > 5000).alias("remote_only"),
        F.when(F.col("salary_min") < 0, 100.0).alias("minimum_salary"),
        F.when(F.col("salary_min") > 9000, "Paris").otherwise("").alias("location"),
        "target_roles", "remote_preference", "salary_min", "locations_preferred")
    return search.with_defaults(asked)


# ---- chunks and vectors -------------------------------------------------------------

@query
def chunk_documents(spark, sf):
    return chunking.chunk_postings(bridge.postings(spark, sf)).select(
        "id", "job_posting_id", "chunk_index", "chunk_text")


@query
def chunk_stats(spark, sf):
    made = chunking.chunk_postings(bridge.postings(spark, sf), size=400, overlap=50)
    return embedding.chunk_stats(made.withColumn("model_name", F.lit(bridge.MODELS[0])))


@query
def model_coverage(spark, sf):
    return embedding.model_coverage(bridge.chunks(spark, sf))


@query
def embedding_status(spark, sf):
    return embedding.status(
        bridge.postings(spark, sf), bridge.chunks(spark, sf), bridge.MODELS[0])


@query
def pending_postings(spark, sf):
    return embedding.next_pending(
        bridge.postings(spark, sf), bridge.chunks(spark, sf), bridge.MODELS[0], 500
    ).select("id", "content_hash", "synced_at")


@query
def unembedded(spark, sf):
    return embedding.without_vectors(
        bridge.postings(spark, sf), bridge.chunks(spark, sf)).select("id", "source", "title")


@query
def coverage_left_join(spark, sf):
    return embedding.coverage(bridge.postings(spark, sf), bridge.chunks(spark, sf))


@query
def vector_checks(spark, sf):
    e = bridge.table(spark, sf, "embeddings")
    return quality.by_rule(e, {
        "dimension is 64": vectors.has_dimension("embedding", 64),
        "dimension is 1024": vectors.has_dimension("embedding", 1024),
        "unit length": F.abs(vectors.norm("embedding") - 1) < 1e-4,
        "label is even": F.col("label") % 2 == 0,
    })


@query
def embed_postings(spark, sf):
    """Chunks, vectors by the hashing embedder, and what came of each posting."""
    made = embedding.embed_postings(
        bridge.postings(spark, sf), embedding.hashing_embedder(64), "hashing-64",
        bridge.as_of("2024-06-03"))
    return made.groupBy("job_posting_id", "model_name", "content_hash").agg(
        F.count("*").alias("chunks"),
        F.min(F.size("embedding")).alias("least_dimension"),
        F.max(F.size("embedding")).alias("most_dimension"),
        F.round(F.min(vectors.norm("embedding")), 4).alias("least_norm"),
        F.round(F.max(vectors.norm("embedding")), 4).alias("most_norm"))


@query
def embed_vectors(spark, sf):
    """Every chunk of every posting: its text's hash, and the places of its vector that are
    not zero with their values in millionths."""
    made = embedding.embed_postings(
        bridge.postings(spark, sf), embedding.hashing_embedder(64), "hashing-64",
        bridge.as_of("2024-06-03"))
    places = F.filter(F.transform("embedding", lambda x, i: F.struct(
        i.alias("i"), F.round(x.cast("double") * 1_000_000).cast("long").alias("v"))),
        lambda p: p["v"] > 0)
    return made.select("id", "chunk_index", F.md5("chunk_text").alias("chunk_hash"), F.array_join(
        F.transform(places, lambda p: F.concat_ws(":", p["i"].cast("string"),
                                                  p["v"].cast("string"))), " ").alias("vector"))


def _refreshed(spark, sf) -> tuple[DataFrame, DataFrame]:
    stored = bridge.chunks(spark, sf)
    todo, fresh = embedding.refresh(
        bridge.postings(spark, sf), stored, embedding.hashing_embedder(64),
        bridge.MODELS[0], bridge.as_of("2024-06-03"))
    return todo, embedding.apply_refresh(stored, todo, fresh)


@query
def embed_refresh(spark, sf):
    """The chunk table after everything pending was embedded again."""
    return _refreshed(spark, sf)[1].groupBy("job_posting_id", "model_name", "content_hash").agg(
        F.count("*").alias("chunks"), F.max("created_at").alias("created_at"))


@query
def embed_refresh_again(spark, sf):
    """What a second refresh would still find: postings without any text."""
    _, after = _refreshed(spark, sf)
    return embedding.pending(
        bridge.postings(spark, sf), after, bridge.MODELS[0]).select("id", "content_hash")


@query
def resume_invalidate(spark, sf):
    old = bridge.profiles(spark, sf).withColumns({
        "resume_embedding": F.array(F.lit(1.0).cast("float")),
        "resume_content_hash": text.content_hash("resume_text"),
        "resume_embedded_at": F.col("updated_at")})
    uploads = old.filter(F.col("remote_preference") == "hybrid").select(
        F.col("id").alias("profile_id"), "user_id",
        F.concat("user_id", F.lit(".md")).alias("filename"),
        F.concat(F.lit("New resume of "), "user_id").alias("resume_text"))
    new = embedding.drop_old_vectors(old, uploads, bridge.as_of("2024-07-01"))
    return new.select(
        "id", "resume_filename", "resume_text",
        F.array_size("resume_embedding").cast("string").alias("dimension"),
        "resume_content_hash", "resume_embedded_at", "updated_at")


# ---- search ----------------------------------------------------------------------

def _search(spark, sf) -> DataFrame:
    return search.search(
        bridge.requests(spark, sf), bridge.chunks(spark, sf), bridge.postings(spark, sf),
        top_k=10)


@query
def semantic_search_topk(spark, sf):
    return _as_text(_search(spark, sf), "remote").select(
        "request_id", "base_rank", "job_posting_id", "chunk_id", "chunk_text", "similarity",
        "source", "remote", "salary_max", "location", "description_preview")


@query
def semantic_search_late(spark, sf):
    """The same search with the filters applied after a first draw."""
    found = search.search(
        bridge.requests(spark, sf), bridge.chunks(spark, sf), bridge.postings(spark, sf),
        top_k=10, late=True)
    return found.select("request_id", "base_rank", "job_posting_id", "chunk_id", "similarity")


@query
def text_search(spark, sf):
    """The benchmark's texts as searches over the chunks of all postings."""
    embed, model = embedding.hashing_embedder(256), "hashing-256"
    p = bridge.postings(spark, sf)
    stored = embedding.embed_postings(p, embed, model, bridge.as_of("2024-06-03"))
    asked = bridge.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("request_id"),
        text.clean_space("text").alias("search_text"))
    found = search.search(search.embedded(asked, embed, model), stored, p, top_k=5)
    return found.select("request_id", "base_rank", "job_posting_id", "chunk_id", "similarity")


@query
def profile_search(spark, sf):
    """From e-mail and text to postings re-ranked by the user's feedback."""
    embed, model = embedding.hashing_embedder(256), "hashing-256"
    p = bridge.postings(spark, sf)
    found = asking.profile_search(
        bridge.asked(spark, sf), bridge.users(spark, sf), bridge.profiles(spark, sf),
        embedding.embed_postings(p, embed, model, bridge.as_of("2024-06-03")), p,
        folds.feedback(bridge.feedback_actions(spark, sf)), embed, model, top_k=5)
    return found.select(
        "request_id", "user_id", "profile_id", "rank", "job_posting_id", "chunk_id",
        "base_similarity", "feedback", "similarity")


@query
def profile_search_refused(spark, sf):
    """Requests that cannot be answered, and why."""
    return asking.resolved(
        bridge.asked(spark, sf), bridge.users(spark, sf), bridge.profiles(spark, sf)
    ).filter("error IS NOT NULL").select("request_id", "error")


# The given vectors form no clusters, so nine of ten results need most of the lists.
LISTS, PROBES = 24, 19


def _lists(spark, sf) -> tuple[DataFrame, list]:
    """Chunks in lists around 24 of the vectors."""
    drawn = bridge.table(spark, sf, "embeddings", "vec_id", "embedding").orderBy(
        F.sha2(F.col("vec_id").cast("string"), 256)).limit(LISTS)
    centres = [list(r["embedding"]) for r in drawn.collect()]
    return search.with_list(bridge.chunks(spark, sf), centres), centres


@query
def approximate_search(spark, sf):
    """What lists of near vectors find of the exact results."""
    listed, centres = _lists(spark, sf)
    found = search.approximate_search(
        bridge.requests(spark, sf), listed, bridge.postings(spark, sf), centres,
        probes=PROBES, top_k=10)
    return search.recall(found, _search(spark, sf))


@query
def approximate_topk(spark, sf):
    """Every fiftieth vector as a request against the lists of all vectors."""
    listed, centres = _lists(spark, sf)
    found = search.approximate_search(
        bridge.vector_requests(spark, sf), listed, bridge.postings(spark, sf), centres,
        probes=PROBES, top_k=10)
    return found.select("request_id", "base_rank", "job_posting_id", "chunk_id", "similarity")


@query
def semantic_search_fresh(spark, sf):
    """Without the chunks whose posting has changed since."""
    found = search.search(
        bridge.requests(spark, sf), bridge.chunks(spark, sf), bridge.postings(spark, sf),
        top_k=20, fresh_only=True)
    return found.select("request_id", "base_rank", "job_posting_id", "chunk_id", "similarity")


@query
def feedback_rerank(spark, sf):
    found = _search(spark, sf).withColumn("user_id", F.col("request_id"))
    signals = folds.feedback(bridge.feedback_actions(spark, sf))
    return search.rerank(found, signals).select(
        "request_id", "rank", "base_rank", "job_posting_id", "base_similarity", "feedback",
        "feedback_adjustment", "similarity")


# ---- profiles, contexts, prompts ------------------------------------------------------

@query
def profile_list(spark, sf):
    found = _as_text(board.profile_list(bridge.profiles(spark, sf)), "resume_characters")
    return found.withColumns({
        c: F.array_join(c, ",") for c in (
            "target_roles", "locations_preferred", "deal_breakers")})


@query
def default_profile(spark, sf):
    return browse.default_profiles(bridge.profile_versions(spark, sf)).select(
        "user_id", "id", "is_default", "created_at")


@query
def single_default(spark, sf):
    return folds.single_default(bridge.profile_versions(spark, sf)).select(
        "id", "user_id", "is_default")


def _pairs(spark, sf) -> DataFrame:
    return bridge.applications(spark, sf).select("user_id", "job_posting_id")


@query
def job_match_context(spark, sf):
    found = insight.match_context(
        _pairs(spark, sf), bridge.profiles(spark, sf), bridge.postings(spark, sf),
        posting_chars=0)
    return _as_text(found, "remote").select(
        "user_id", "job_posting_id", "profile_id", "label",
        F.array_join("target_roles", ",").alias("target_roles"), "remote_preference",
        "profile_salary_min", "resume_text", "title", "company", "location", "remote",
        "salary_min", "salary_max", F.col("description_chars").alias("n_chars"),
        "apply_url")


@query
def grounded_prompts(spark, sf):
    context = insight.match_context(
        _pairs(spark, sf), bridge.profiles(spark, sf), bridge.postings(spark, sf),
        insight.PROMPT_CHARS, insight.PROMPT_CHARS)
    made = insight.prompts(context, "resume_bullet")
    return made.select(
        "user_id", "job_posting_id", "format", F.length("prompt").alias("n_chars"),
        F.sha2("prompt", 256).alias("prompt_hash"))


@query
def user_lookup(spark, sf):
    asked = bridge.table(spark, sf, "events", "event_id", "user_id", "event_type").select(
        "event_id", F.concat(
            F.lit("  CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
            F.when(F.col("event_type") == "error", "@other.example.com")
            .otherwise("@Example.com ")).alias("user_email"))
    known, unknown = people.lookup_users(asked, bridge.users(spark, sf))
    return known.select("event_id", "user_id").unionByName(
        unknown.select("event_id", F.lit(None).cast("string").alias("user_id")))


# ---- board -----------------------------------------------------------------------

@query
def posting_stats(spark, sf):
    return board.posting_stats(bridge.postings(spark, sf))


@query
def stage_funnel(spark, sf):
    return board.stage_funnel(bridge.applications(spark, sf))


def _day() -> F.Column:
    return bridge.as_of(AS_OF).cast("date")


@query
def stage_board(spark, sf):
    rows = board.board(
        bridge.applications(spark, sf), bridge.postings(spark, sf), bridge.notes(spark, sf),
        _day())
    return _as_text(rows, "remote", "next_follow_up").select(
        "id", "user_id", "job_posting_id", "stage", "stage_rank", "stage_updated_at",
        "title", "company", "location", "remote", "apply_url", "note_count",
        "next_follow_up")


@query
def stage_board_counts(spark, sf):
    return board.board_counts(
        bridge.applications(spark, sf), folds.bookmarks(bridge.bookmark_actions(spark, sf)))


@query
def recent_activity(spark, sf):
    return board.recent_activity(
        bridge.applications(spark, sf), bridge.users(spark, sf), bridge.postings(spark, sf),
        bridge.notes(spark, sf), 25)


@query
def stale_applications(spark, sf):
    return board.stale_report(
        bridge.applications(spark, sf), bridge.users(spark, sf), bridge.postings(spark, sf),
        bridge.as_of(AS_OF))


@query
def stale_oldest_first(spark, sf):
    """The five applications of each user that wait longest."""
    return board.oldest_stale(stale_applications(spark, sf), 5).select(
        "id", "email", "stage_updated_at", "rank")


@query
def stale_flag_refresh(spark, sf):
    earlier = bridge.applications(spark, sf).withColumns({
        "is_stale": F.month("stage_updated_at") % 2 == 0,
        "stale_flagged_at": F.when(
            F.month("stage_updated_at") % 2 == 0, bridge.as_of("1997-12-01"))})
    return folds.refresh_stale(earlier, bridge.as_of(AS_OF)).select(
        "id", "stage", "stage_updated_at", "is_stale", "stale_flagged_at")


@query
def feedback_distribution(spark, sf):
    return board.feedback_mix(folds.feedback(bridge.feedback_actions(spark, sf)))


@query
def recent_feedback(spark, sf):
    return board.recent_feedback(
        folds.feedback(bridge.feedback_actions(spark, sf)), bridge.users(spark, sf),
        bridge.postings(spark, sf))


@query
def saved_with_posting(spark, sf):
    return board.saved_with_posting(
        folds.bookmarks(bridge.bookmark_actions(spark, sf)), bridge.postings(spark, sf)
    ).select("user_id", "job_posting_id", "note", "saved_at", "title", "company", "location")


@query
def note_ownership(spark, sf):
    notes = dealt(bridge.notes(spark, sf), "application_id", "user_id")
    counted = notes.groupBy("application_id", "user_id").agg(
        F.count("*").alias("notes"))
    accepted, refused = board.own_notes(counted, bridge.applications(spark, sf))
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        refused.withColumn("accepted", F.lit(False)))


# ---- folds -----------------------------------------------------------------------

@query
def feedback_fold(spark, sf):
    return folds.feedback(bridge.feedback_actions(spark, sf))


@query
def application_fold(spark, sf):
    return folds.applications(bridge.stage_actions(spark, sf))


@query
def bookmark_fold(spark, sf):
    return folds.bookmarks(bridge.bookmark_actions(spark, sf))


@query
def stage_transitions(spark, sf):
    return folds.transition_counts(bridge.stage_actions(spark, sf))


def _logins(spark, sf) -> DataFrame:
    return bridge.actions(spark, sf).select(
        F.concat(
            F.lit(" CUSTOMER#"), F.lpad("user_id", 9, "0"),
            F.when(F.col("event_type") == "error", "@new.example.com")
            .otherwise("@example.com")).alias("email"),
        F.when(F.col("event_type") == "signup", F.concat(
            F.lit("Name "), F.col("seq").cast("string"))).alias("display_name"),
        "ts", "seq")


@query
def user_upsert(spark, sf):
    logins = _logins(spark, sf)
    return folds.users(logins, bridge.users(spark, sf))


@query
def posting_upsert(spark, sf):
    """Two landings: a state, then a batch that changes some and adds others."""
    raw = bridge.raw_postings(spark, sf)
    state = merge.upsert_postings(
        _no_rows(spark, raw),
        prepare.prepare(raw.filter(F.col("category") != "de"), ["ingest_seq"]),
        bridge.as_of("2024-06-01"))
    batch = raw.filter(F.col("category").isin("de", "en")).withColumn(
        "description_text", F.concat(F.lit("updated "), "description_text"))
    return merge.upsert_postings(
        state, prepare.prepare(batch, ["ingest_seq"]), bridge.as_of("2024-06-08")
    ).select("id", "category", "content_hash", "synced_at")


def _no_rows(spark, raw: DataFrame) -> DataFrame:
    return spark.createDataFrame([], raw.schema.add("content_hash", "string"))


@query
def chunk_replace(spark, sf):
    """Chunks of the English postings made anew with another size."""
    p = bridge.postings(spark, sf)
    stored = chunking.chunk_postings(p)
    english = p.filter(F.col("category") == "en")
    fresh = chunking.chunk_postings(english, size=500, overlap=100)
    return merge.replace_groups(stored, fresh, ["job_posting_id"]).groupBy(
        "job_posting_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("n_chars"))


# ---- insight ---------------------------------------------------------------------

@query
def skill_gap_scan(spark, sf):
    return insight.skill_gap(
        bridge.applications(spark, sf).select("profile_id", "job_posting_id"),
        bridge.profiles(spark, sf), bridge.postings(spark, sf), TERMS)


@query
def skill_gap_ranked(spark, sf):
    return insight.skill_gap_ranked(skill_gap_scan(spark, sf))


@query
def skill_gap_words(spark, sf):
    return insight.skill_gap(
        bridge.applications(spark, sf).select("profile_id", "job_posting_id"),
        bridge.profiles(spark, sf), bridge.postings(spark, sf), TERMS, whole_words=True)


@query
def skill_gap_summary(spark, sf):
    pairs = bridge.applications(spark, sf).select("profile_id", "job_posting_id")
    p = bridge.postings(spark, sf)
    gap = insight.skill_gap(pairs, bridge.profiles(spark, sf), p, TERMS)
    return insight.skill_gap_summary(gap, pairs, p)


@query
def skill_mentions(spark, sf):
    """How many postings mention each term, zero left out."""
    return bridge.postings(spark, sf).select(
        text.matched("description_text", TERMS).alias("found")
    ).select(text.each("found", len(TERMS)).alias("skill")).groupBy("skill").agg(F.count("*").alias("jobs_mentioning"))


@query
def skill_gap_except(spark, sf):
    return insight.missing_skills(
        bridge.required_skills(spark, sf), bridge.profile_skills(spark, sf))


@query
def skill_present_intersect(spark, sf):
    return insight.present_skills(
        bridge.required_skills(spark, sf), bridge.profile_skills(spark, sf))


@query
def listing_risk(spark, sf):
    found = insight.listing_risk(bridge.postings(spark, sf), RISK_TERMS)
    return _as_text(found, "http_status").withColumn(
        "flags", F.array_join("flags", "; ")).drop("notice")


@query
def listing_risk_checked(spark, sf):
    found = insight.listing_risk(
        bridge.postings(spark, sf), RISK_TERMS, bridge.url_status(spark, sf))
    return _as_text(found, "http_status").withColumn(
        "flags", F.array_join("flags", "; ")).drop("notice")


# ---- quality ---------------------------------------------------------------------

def _state_tables(spark, sf) -> dict[str, DataFrame]:
    return {
        "users": bridge.users(spark, sf), "profiles": bridge.profiles(spark, sf),
        "job_postings": bridge.postings(spark, sf),
        "applications": bridge.applications(spark, sf),
        "interview_notes": bridge.notes(spark, sf),
        "job_posting_embeddings": bridge.chunks(spark, sf),
        "job_feedback": folds.feedback(bridge.feedback_actions(spark, sf)),
        "saved_jobs": folds.bookmarks(bridge.bookmark_actions(spark, sf)),
    }


@query
def orphans(spark, sf):
    """Counts for every reference of the model, and one that has orphans."""
    tables = {k: v for k, v in _state_tables(spark, sf).items()}
    extra = [("job_postings", "id", "job_posting_embeddings", "job_posting_id"),
             ("users", "id", "applications", "user_id")]
    return quality.orphan_counts(tables, schemas.REFERENCES + extra)


@query
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(
        bridge.applications(spark, sf), schemas.KEYS["applications"][1])


@query
def domain_violations(spark, sf):
    apps = bridge.table(spark, sf, "orders").select(
        F.lower(F.substring_index("o_orderpriority", "-", -1)).alias("stage"),
        F.col("o_orderstatus").alias("status"))
    return quality.domain_violations(
        apps, {"stage": domains.STAGES + ("low", "high"), "status": ("O", "F")})


@query
def missing_values(spark, sf):
    return quality.missing_values(
        bridge.postings(spark, sf),
        ["id", "title", "location", "remote", "salary_max", "apply_url", "posted_at"])


@query
def schema_conformance(spark, sf):
    return quality.conformance(
        bridge.applications(spark, sf), schemas.schema("applications"))


@query
def table_inventory(spark, sf):
    return quality.inventory({
        name: bridge.table(spark, sf, name) for name in (
            "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
            "events", "documents", "embeddings", "pages", "benchmark", "labels",
            "conversations")})


@query
def label_mix(spark, sf):
    """Postings by label, also those that nobody has labelled."""
    d = bridge.table(spark, sf, "documents", "doc_id", "source")
    marks = bridge.table(spark, sf, "labels")
    marked = _as_text(d.join(marks, "doc_id", "left"), "quality", "toxic")
    return marked.groupBy("quality", "toxic").agg(
        F.count("*").alias("postings"), F.count_distinct("source").alias("sources"))


@query
def contact_validation(spark, sf):
    c = spread(bridge.table(spark, sf, "customer"), "c_custkey")
    n = F.col("c_custkey")
    contacts = c.select(
        n.alias("contact_id"),
        F.when(n % 10 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), "c_name"))
        .alias("name"),
        F.repeat("c_mktsegment", (n % 40).cast("int")).alias("role"),
        F.lit("").alias("company"),
        pick_email(n).alias("email"),
        F.col("c_acctbal").cast("string").alias("phone"),
        F.lit(None).cast("string").alias("linkedin_url"),
        F.repeat(F.lit("note "), (n % 1100).cast("int")).alias("notes"))
    checked = rules.check(people.tidy_contacts(contacts),
                          people.contact_rules() + [rules.email("email")])
    return checked.select(
        "contact_id", "name", "company", "email", F.array_join("errors", " ").alias("errors"))


def pick_email(n):
    return bridge.pick(n % 5, {
        0: F.concat(F.lit("A"), n.cast("string"), F.lit("@Example.com ")), 1: "not-an-email",
        2: "@start", 3: "end@"}, None)


@query
def profile_validation(spark, sf):
    o = bridge.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    made = o.select(
        n.alias("profile_id"),
        F.when(n % 9 == 0, " ").otherwise(F.repeat(F.lit("label"), (n % 30).cast("int")))
        .alias("label"),
        F.split(F.concat(F.lit(" a;; b ;"), "o_orderpriority"), ";").alias("target_roles"),
        F.transform(F.sequence(F.lit(0), (n % 30).cast("int")), lambda i: i.cast("string"))
        .alias("locations_preferred"),
        F.col("o_orderpriority").alias("seniority"),
        bridge.pick(n % 4, {0: "hybrid", 1: "", 2: "sometimes"}).alias("remote_preference"),
        F.when(n % 6 == 0, 0.0).when(n % 7 == 0, -F.col("o_totalprice"))
        .otherwise(F.col("o_totalprice")).alias("salary_min"))
    checked = rules.check(people.tidy_profiles(made), people.profile_rules())
    return checked.select(
        "profile_id", "remote_preference", "salary_min",
        F.array_join("target_roles", "|").alias("target_roles"),
        F.array_join("locations_preferred", "|").alias("locations_preferred"),
        F.array_join("errors", " ").alias("errors"))


@query
def note_validation(spark, sf):
    i = bridge.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate",
                     "l_returnflag")
    made = i.select(
        F.when(F.col("l_returnflag") == "N", "").otherwise("a note").alias("note"),
        bridge.pick(F.col("l_linenumber"), {
            1: "phone_screen", 2: "technical", 3: "lunch", 4: ""}).alias("interview_type"),
        bridge.pick(F.col("l_linenumber"), {
            5: "tomorrow", 6: "", 7: "2024-13-01"},
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias("follow_up_date"))
    return rules.check(made, people.note_rules()).groupBy(
        F.array_join("errors", " ").alias("errors")).agg(F.count("*").alias("notes"))


@query
def note_sink(spark, sf):
    """Notes appended to a table where they are valid, and kept with their reasons where not."""
    made = bridge.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate",
                        "l_returnflag").select(
        F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("seq"),
        F.when(F.col("l_returnflag") == "N", "  ").otherwise("a note").alias("note"),
        bridge.pick(F.col("l_linenumber"), {1: "phone_screen", 3: "lunch"}).alias("interview_type"),
        F.when(F.col("l_linenumber") == 5, "tomorrow").otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias("follow_up_date"))
    accepted, refused = (session.working_dir(spark, x) for x in ("notes", "refused-notes"))
    rules.append(rules.check(made, people.note_rules()), accepted, refused)
    good = spark.read.parquet(accepted).withColumn("errors", F.lit(""))
    bad = spark.read.parquet(refused).withColumn("errors", F.array_join("errors", " "))
    return good.unionByName(bad)


@query
def resume_validation(spark, sf):
    """Documents as resumes, with names of growing length."""
    n = F.col("doc_id")
    made = bridge.table(spark, sf, "documents").select(
        n.alias("resume_id"),
        F.when(n % 11 == 0, " ").otherwise(F.repeat(F.lit("name."), (n % 60).cast("int") + 1))
        .alias("filename"), F.when(n % 13 != 0, F.col("text")).alias("resume_text"))
    return rules.check(made, people.resume_rules()).select(
        "resume_id", F.array_join("errors", " ").alias("errors"))


@query
def bookmark_validation(spark, sf):
    n = F.col("event_id")
    made = bridge.table(spark, sf, "events").select(
        n.alias("bookmark_id"),
        F.when(n % 9 == 0, "").otherwise(F.repeat(F.lit("posting"), (n % 80).cast("int") + 1))
        .alias("job_posting_id"), F.repeat(F.lit("keep "), (n % 1100).cast("int")).alias("note"))
    return rules.check(made, people.bookmark_rules()).select(
        "bookmark_id", F.array_join("errors", " ").alias("errors"))


@query
def feedback_validation(spark, sf):
    e = spread(bridge.actions(spark, sf), "seq").select(
        F.when(F.col("value") > 30, " ").otherwise(F.col("job_posting_id"))
        .alias("job_posting_id"),
        bridge.pick(F.col("event_type"), {
            "purchase": " Good", "error": "BAD ", "view": "skip", "click": "maybe"})
        .alias("feedback"),
        F.repeat(F.lit("reason"), F.floor("value").cast("int") * 10).alias("reason"))
    return rules.check(people.tidy_feedback(e), people.feedback_rules()).groupBy(
        F.array_join("errors", " ").alias("errors")).agg(F.count("*").alias("rows"))


@query
def search_validation(spark, sf):
    """Search texts: the turns of the conversations."""
    asked = bridge.table(spark, sf, "conversations").select(
        "role", F.col("text").alias("query"))
    return rules.check(asked, people.search_rules()).groupBy(
        "role", F.array_join("errors", " ").alias("errors")).agg(F.count("*").alias("requests"))


# ---- runs ------------------------------------------------------------------------

@query
def run_history(spark, sf):
    return runlog.history(bridge.runs(spark, sf), 20)


@query
def latest_run(spark, sf):
    return runlog.latest(bridge.runs(spark, sf))


@query
def run_totals(spark, sf):
    return bridge.runs(spark, sf).groupBy("status").agg(
        F.count("*").alias("runs"), F.sum("fetched_rows").alias("fetched_rows"),
        F.max("started_at").alias("last_started_at"))


# ---- scalars ---------------------------------------------------------------------

@query
def scalar_battery(spark, sf):
    o = bridge.table(spark, sf, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    as_of = bridge.as_of(AS_OF)
    return o.select(
        "o_orderkey",
        F.lower("o_orderpriority").alias("lowered"),
        F.length("o_orderpriority").alias("n_chars"),
        text.preview("o_orderpriority", 4).alias("preview"),
        F.contains("o_orderpriority", F.lit("HIGH")).alias("is_high"),
        F.col("o_orderpriority").like("%_-L%").alias("is_like"),
        F.col("o_orderpriority").ilike("%low%").alias("is_ilike"),
        F.size(F.split("o_orderpriority", " ")).alias("n_words"),
        F.concat_ws(":", F.lower("o_orderstatus"), k.cast("string")).alias("key"),
        text.content_hash("o_orderpriority").alias("hash"),
        F.datediff(as_of.cast("date"), d.cast("date")).alias("days_since"),
        (as_of - F.make_dt_interval(days=F.lit(14)) > d).alias("is_old"),
        text.iso_text(d).alias("iso"),
        text.to_number(F.concat("o_totalprice", F.when(k % 3 == 0, "x").otherwise("")))
        .alias("number"),
        F.greatest(F.lit(1), F.least(F.lit(25), k % 100)).alias("clamped"),
        F.round(F.col("o_totalprice") / 7, 6).alias("rounded"),
        text.first_filled(F.when(k % 2 == 0, "").otherwise("odd"), F.lit("even"))
        .alias("filled"),
        F.get(F.split("o_orderpriority", "-"), F.lit(1)).alias("second"),
        F.get(F.split("o_orderpriority", "-"), F.lit(9)).alias("ninth"),
        F.array_join(text.clean_list(F.split("o_orderpriority", "[- ]"), 2), "+")
        .alias("two"),
        text.flag(bridge.pick(k % 4, {0: "YES", 1: "1", 2: "True"}, "no")).alias("flag"),
        text.looks_remote(F.when(k % 5 == 0, "Fully REMOTE"), F.col("o_orderstatus"))
        .alias("remote"),
        text.parse_day(F.concat(F.date_format(d, "yyyy-MM"), F.lit("-30")))
        .cast("string").alias("day"),
    )


@query
def vector_distances(spark, sf):
    """Distance of every vector to the mean of its label."""
    e = bridge.table(spark, sf, "embeddings")
    means = bridge.requests(spark, sf).select(
        F.col("request_id").cast("int").alias("label"), "vector")
    return e.join(means, "label").select(
        "vec_id", F.round(vectors.cosine_distance("embedding", "vector"), 6).alias("distance"))


@query
def vector_text(spark, sf):
    """Every vector in its text form."""
    return bridge.table(spark, sf, "embeddings").select(
        "vec_id", vectors.literal("embedding").alias("vector"))


@query
def refresh_stream(spark, sf):
    """Postings landed as JSON, refreshed by a stream; the stored postings."""
    from ..streaming import refresh as streams
    from . import refresh
    home = session.working_dir(spark, "stream")
    bridge.resent_postings(spark, sf).withColumn(
        "ingest_seq", F.col("ingest_seq") + F.col("landing") * 10**12).drop(
        "landing", "synced_at").write.json(f"{home}/landing", compression="gzip")
    streams.postings_stream(
        spark, f"{home}/landing", f"{home}/store", f"{home}/checkpoint",
        embedding.hashing_embedder(64), "hashing-64", datetime(2024, 6, 1), buckets=8
    ).awaitTermination()
    store = refresh.Store(spark, f"{home}/store", 8)
    made = store.table("job_posting_embeddings").read().groupBy("job_posting_id").agg(
        F.count("*").alias("chunks"))
    return store.table("job_postings").read().join(
        made, F.col("id") == F.col("job_posting_id"), "left").select(
        "id", "title", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query
def feedback_stream(spark, sf):
    """Feedback landed in three unordered files, folded by a stream batch by batch."""
    from ..sources.tables import StateTable
    from ..streaming import refresh as streams
    home = session.working_dir(spark, "actions")
    ddl = ("user_id STRING, job_posting_id STRING, feedback STRING, reason STRING, "
           "ts TIMESTAMP, seq BIGINT")
    bridge.feedback_actions(spark, sf).repartition(3, "seq").write.option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{home}/landing")
    state = StateTable(spark, f"{home}/state", schemas.schema("job_feedback"),
                       schemas.KEYS["job_feedback"][1], 8)
    streams.actions_stream(
        spark, f"{home}/landing", ddl, f"{home}/log", state, folds.feedback,
        f"{home}/checkpoint", files_per_batch=1).awaitTermination()
    return state.read().withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


def _streamed(spark, sf, actions: DataFrame, fold: states.Mergeable) -> DataFrame:
    """The fold of actions that land in three unordered files, one per micro-batch; states
    are merged on disk after two of them have been read, and again by the reader."""
    from ..streaming import states as streams
    home = session.working_dir(spark, "states")
    ddl = ", ".join(f"`{f.name}` {'TIMESTAMP' if f.name == 'ts' else f.dataType.simpleString()}"
                    for f in actions.schema)
    land = lambda part: actions.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == part).coalesce(
        1).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").mode(
        "append").json(f"{home}/landing")
    run = lambda: streams.fold_stream(
        spark, f"{home}/landing", ddl, f"{home}/state", fold, f"{home}/checkpoint",
        files_per_batch=1).awaitTermination()
    land(0), land(1), run()
    streams.compact(spark, f"{home}/state", fold, ddl)
    land(2), run()
    folded = fold.finish(streams.merged(spark, f"{home}/state", fold, ddl))
    return folded.withColumns({f.name: F.col(f.name).cast("timestamp_ntz")
                               for f in folded.schema if f.dataType.typeName() == "timestamp"})


@query
def application_stream(spark, sf):
    return _streamed(spark, sf, bridge.stage_actions(spark, sf), states.APPLICATIONS)


@query
def bookmark_stream(spark, sf):
    return _streamed(spark, sf, bridge.bookmark_actions(spark, sf), states.BOOKMARKS)


@query
def user_stream(spark, sf):
    return _streamed(spark, sf, _logins(spark, sf), states.USERS)


PAGE = 100


def _land(feed: DataFrame, wrap: Callable, path: str) -> None:
    """Feed documents of up to a hundred postings, one per line."""
    page = F.floor(F.col("ingest_seq") / PAGE)
    (feed.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(
        F.struct("ingest_seq", "raw")))["raw"].alias("items"))
     .select(wrap(F.col("items")).alias("value")).write.text(path, compression="gzip"))


@query
def refresh_run(spark, sf):
    """A whole run over the three landed feeds; what it stored, by source."""
    from . import refresh
    home = session.working_dir(spark, "run")
    _land(bridge.feed_a(spark, sf), lambda x: F.to_json(F.struct(x.alias("results"))),
          f"{home}/landing/a")
    _land(bridge.feed_b(spark, sf), lambda x: F.to_json(F.struct(F.struct(
        x.alias("SearchResultItems")).alias("SearchResult"))), f"{home}/landing/b")
    _land(bridge.feed_c(spark, sf), F.to_json, f"{home}/landing/c")
    paths = {name: f"{home}/landing/{part}" for name, part in zip(domains.SOURCES, "abc")}
    refresh.run(
        spark, f"{home}/store", paths, [{"keyword": ""}], embedding.hashing_embedder(64),
        "hashing-64", limit_per_source=None, embed_limit=None, as_of=datetime(2024, 6, 1),
        buckets=8, lines=True)
    store = refresh.Store(spark, f"{home}/store", 8)
    made = embedding.coverage(
        store.table("job_postings").read(), store.table("job_posting_embeddings").read())
    run = spark.read.parquet(f"{home}/store/pipeline_runs").filter("status = 'completed'")
    return made.join(run.select(
        F.explode(F.from_json("metrics", "rows_by_source MAP<STRING, BIGINT>")
                  ["rows_by_source"]).alias("source", "logged_postings")), "source")
