"""A library of saved pages: add, enrich, index, search, forget, jobs, report.

The state is a folder of versioned tables, cut into buckets by key.  Adding, enriching and indexing are incremental: what the
fingerprints say is current is not done again, and only the buckets of what changed are rewritten.  Extraction tiers,
enrichment providers and embedding are functions that a caller may replace.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schema
from larder.functions import envelope as E
from larder.functions import models as MD
from larder.functions import pricing
from larder.functions import tags as TG
from larder.functions import text as X
from larder.functions import urls as U
from larder.operators import chunking as C
from larder.operators import heuristics as H
from larder.operators import merge as M
from larder.operators import retrieval as R
from larder.operators import store as S
from larder.operators import telemetry as T
from larder.operators.embedding import embed
from larder.options import Options
from larder.sources import payloads as P
from larder.sources import web as W

DOCUMENTS = """
    url_hash string, platform string, category string, content_type string, title string, summary string, description string, tags string,
    entities string, body string, source_hash string, enriched boolean, indexed_at timestamp"""
#: Columns of a record that an extraction gives.
RECORD = [*W.COLUMNS, "transcript", "ocr_text", "visual_description", "raw"]
#: What a page may come with, beside its address.
INPUTS = ["payload", "video_json", "managed_json", *W.BODIES]
WANTS = ["url_hash", "canonical_url", "platform", "document", "media_url", "duration_s", "mode"]


def default_tiers() -> tuple[M.Tier, ...]:
    """The tiers that read what is at hand; fetching is a caller's business."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    any_body = F.greatest(*[some(c) for c in W.BODIES])
    return (
        M.Tier("client_payload", lambda d: P.client_records(d, "url_hash", "payload"), some("payload")),
        M.Tier("yt_dlp", lambda d: P.video_metadata(d, "url_hash", "video_json"), some("video_json")),
        M.Tier("managed_api", lambda d: P.managed_records(d, "url_hash", "managed_json"), some("managed_json")),
        M.Tier("open_graph", W.web_records, any_body),
    )


@dataclass
class Report:
    """What indexing did."""

    indexed: int = 0
    skipped: int = 0
    failed: int = 0
    chunks: int = 0
    vectors: int = 0
    notes: list[str] = field(default_factory=list)


@dataclass
class Answer:
    """Hits of a search, and what there is to say about it."""

    hits: DataFrame
    mode: str
    notes: list[str]
    vector_available: bool


def _one_a_page(found: DataFrame) -> DataFrame:
    """One row of the addresses of each page: the first address, and each input from the first address that has it.

    Addresses go by their text, equal ones by their inputs' hash, so the result says nothing of how the rows were dealt.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("url", F.xxhash64(c)))).alias(c)
    return found.groupBy("url_hash").agg(F.min("url").alias("url"), *[first(c) for c in found.columns if c not in ("url", "url_hash")]).select(*found.columns)


class Library:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        o = self.options
        self.tiers = list(o.tiers if o.tiers is not None else default_tiers())

        def at(name: str, kind: str, key: str = "url_hash", order: tuple[str, ...] = ()) -> S.Table:
            return S.Table(spark, f"{self.path}/{name}", kind, key, o.buckets, order)

        self.envelopes = at("envelopes", schema.ENVELOPES + ", created_at timestamp, updated_at timestamp, signal string")
        self.enrichments = at("enrichments", schema.ENRICHMENTS)
        self.tag_rows = at("tags", "url_hash string, tag string, position int", order=("tag",))
        self.attempts = at("attempts", schema.ATTEMPTS)
        self.documents = at("documents", DOCUMENTS)
        self.chunks = at("chunks", schema.CHUNKS)
        self.vectors = at("vectors", schema.VECTORS, order=("model", "dim"))
        self.postings = at("postings", "token string, url_hash string, field string, positions array<int>", order=("token",))
        self.lengths = at("lengths", "url_hash string, dl double")
        self.jobs = at("jobs", schema.JOBS, "job_id")

    def _kept(self, df: DataFrame) -> DataFrame:
        """df written and read again: what makes it runs once."""
        path = f"{self.path}/_scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clean(self) -> None:
        """Removes scratch tables and folders that no version names."""
        for t in vars(self).values():
            if isinstance(t, S.Table):
                t.vacuum()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_scratch")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # -- writing -----------------------------------------------------------------------

    def add(self, pages: DataFrame, force: bool = False, retry_degraded: bool = True) -> DataFrame:
        """Extracts pages(url and any of INPUTS) that are not known yet (or degraded); the new envelopes."""
        have = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in INPUTS]
        found = _one_a_page(U.with_canonical(pages.select("url", *have)).filter("url_hash IS NOT NULL"))
        if not force:
            stored = self.envelopes.read().select("url_hash", "degraded")
            found = M.not_cached(found, stored, "url_hash", retry_degraded)
        found = self._kept(found)
        kinds = {f.name: f.dataType for f in self.envelopes.read().schema}

        def prepare(records: DataFrame, mine: DataFrame) -> DataFrame:
            note = F.col("extractor_note") if "extractor_note" in records.columns else F.lit(None).cast("string").alias("extractor_note")
            some = [F.col(c).cast(kinds[c]) if c in records.columns else F.lit(None).cast(kinds[c]).alias(c) for c in RECORD]
            out = records.select("url_hash", *some, note).join(mine.select("url_hash", "platform"), "url_hash")
            out = out.withColumn("media_kind", F.coalesce("media_kind", W.media_kind())).filter(E.is_usable())
            return out.withColumn("signal", E.signal()).drop("platform")

        only_said = (F.col("tier") == "client_payload") & (F.col("signal") == "weak") & E.needs_media() & (F.coalesce("media_url", F.lit("")) == "")
        why = F.when(F.col("signal") == "none", "partial: media only, no text").otherwise("partial: client metadata; trying richer video extraction")
        made, tried = M.run_cascade(found, self.tiers, "url_hash", prepare, (F.col("signal") == "none") | only_said, why, self._kept)
        now = F.current_timestamp()
        self.attempts.append(tried.withColumns({"duration_ms": F.lit(None).cast("bigint"), "created_at": now}))
        base = found.select("url_hash", "canonical_url", F.col("url").alias("original_url"), "platform")
        if made is not None:
            merged = M.cascade(made, "url_hash", "rank", F.col("partial"), [c for c in RECORD if c != "media_kind"], ["media_kind", "tier", "extractor_note"])
            base = base.join(merged.drop("tiers_run", "stopped"), "url_hash", "left")
        for c in [*RECORD, "tier", "extractor_note"]:
            if c not in base.columns:
                base = base.withColumn(c, F.lit(None).cast(kinds[c]))
        out = base.withColumn("media_kind", F.coalesce("media_kind", F.lit("unknown"))).withColumn("signal", E.signal())
        none, failed = F.col("signal") == "none", F.col("tier").isNull()
        note = F.when(failed, "all tiers failed; URL retained for reprocessing").when(none, F.trim(F.concat(F.coalesce("extractor_note", F.lit("")), F.lit(" (no text signal)")))).otherwise(F.col("extractor_note"))
        out = out.withColumns({"degraded": none, "reprocessable": F.lit(True), "extractor_note": note, "tier": F.coalesce("tier", F.lit("degraded")), "extracted_at": now, "created_at": now, "updated_at": now})
        new = self._kept(out.select(*[F.col(c).cast(k) for c, k in kinds.items()]))
        self.envelopes.upsert(new)
        return new

    def _document(self, env: DataFrame) -> DataFrame:
        """Envelopes with the text to index, its fingerprint and the mode that suits them."""
        env = env.withColumn("document", E.search_document())
        env = env.withColumn("source_hash", C.fingerprint(F.col("platform"), F.col("document"), F.col("media_url"), F.col("duration_s")))
        o = self.options
        mode = pricing.enrichment_mode(F.col("signal"), F.coalesce("media_url", F.lit("")), F.col("media_kind"), F.col("duration_s"), o.longest_media_s) if o.allow_media else F.lit("metadata")
        predicted = MD.preflight_cost(F.col("duration_s"), o.longest_media_s, o.priced_model)
        env = env.withColumns({"wanted": mode, "mode": pricing.within_budget(mode, predicted, o.most_usd_an_item) if o.enrichers else mode, "predicted": predicted})
        over = F.format_string("media skipped: predicted $%.4f exceeds ceiling $%.4f", "predicted", F.lit(float(o.most_usd_an_item)))
        return env.withColumn("budget_note", F.when(F.col("wanted") != F.col("mode"), over))

    def preview(self, force: bool = False) -> DataFrame:
        """What enriching would do: the mode of each item and the predicted dollars of its media, before any call."""
        env = self._document(self.envelopes.read())
        env = env if force else S.changed(env, self.enrichments.read(), "url_hash")
        return env.select("url_hash", "canonical_url", "mode", F.when(F.col("wanted") == "media", F.col("predicted")).otherwise(0.0).alias("predicted_usd"), "budget_note")

    def enrich(self, force: bool = False, only: DataFrame | None = None, mode: str | None = None) -> DataFrame:
        """Enriches envelopes without a current enrichment by the providers, the model-free one last; the new enrichments."""
        env = self.envelopes.read() if only is None else self.envelopes.read().join(only.select("url_hash"), "url_hash", "left_semi")
        env = self._document(env)
        if not force:
            env = S.changed(env, self.enrichments.read(), "url_hash")
        if mode is not None:
            env = env.withColumns({"mode": F.lit(mode), "budget_note": F.lit(None).cast("string")})
        env = self._kept(env.drop("wanted", "predicted"))
        waiting, made, notes = env, [], []
        for step in ("media", "metadata"):
            for p in self.options.enrichers:
                if not p.available:
                    notes += [n for n in [f"{p.name} unavailable ({p.reason})"] if n not in notes]
                    continue
                if step not in p.modes:
                    continue
                asked = waiting if step == "metadata" else waiting.filter("mode = 'media'")
                asked = asked.withColumns({"mode": F.lit(step), "document": X.trim_document(F.col("document"), self.options.longest_document)})
                try:
                    got = self._kept(self._answered(p, asked.select(*WANTS), env, step))
                except Exception as failure:  # a provider that fails costs only itself
                    notes.append(f"{p.name} {step} failed: {type(failure).__name__}")
                    continue
                made.append(got)
                waiting = waiting.join(got.select("url_hash"), "url_hash", "left_anti")
        made.append(self._by_rule(waiting, "; ".join([*notes, "fell back to offline keyword extraction"] if self.options.enrichers else notes)))
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        out = self._kept(out.select(*self.enrichments.read().columns))
        self.enrichments.replace(out)
        self.tag_rows.replace(S.tag_rows(out, "url_hash"), out)
        return out

    def _answered(self, provider, asked: DataFrame, env: DataFrame, mode: str) -> DataFrame:
        """A provider's answers as enrichments."""
        got = provider.enrich(asked).select("url_hash", "answer", "model", "input_tokens", "output_tokens")
        got = got.join(env.select("url_hash", "platform_tags", "source_hash", "budget_note"), "url_hash").withColumn("a", MD.answer(F.col("answer"), F.col("platform_tags"))).filter("a IS NOT NULL")
        return got.select("url_hash", "a.*", "model", F.col("input_tokens").cast("bigint"), F.col("output_tokens").cast("bigint"), "source_hash", "budget_note").withColumns({
            "mode": F.lit(mode), "provider": F.lit(provider.name), "prompt_version": F.lit(1), "cost_usd": pricing.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")),
            "duration_ms": F.lit(None).cast("bigint"), "degraded": F.lit(False), "note": F.col("budget_note"),
        }).drop("budget_note")

    def _by_rule(self, env: DataFrame, said: str) -> DataFrame:
        """Enrichments from the text alone."""
        stop = list(self.options.stopwords)
        prose = F.concat_ws(" ", "caption", "article_text", "transcript", "visual_description")
        rows = env.select("url_hash", "document", "title", "caption", F.array_join("platform_tags", " ").alias("labels"), prose.alias("prose"))
        terms = H.top_terms(rows, "url_hash", "document", {"title": 4, "caption": 2, "labels": 5}, "prose", stop, 25, dedup=True)
        by = terms.groupBy("url_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("terms"))
        plain = H.without_repeated_sentences(env, "url_hash", "document").withColumnRenamed("document", "plain")
        e = env.join(by, "url_hash", "left").join(plain, "url_hash")
        body, none = F.coalesce("caption", "article_text", "transcript"), F.array().cast("array<string>")
        note = F.concat_ws("; ", F.lit("keyword extraction; no language model was used"), "budget_note", F.lit(said or None).cast("string"))
        has_article = F.coalesce("article_text", F.lit("")) != ""
        return e.select(
            "url_hash", H.summary(F.col("title"), F.col("caption"), F.col("article_text"), F.col("author"), F.col("media_kind")).alias("summary"), H.description(body, F.col("document")).alias("description"),
            none.alias("details"), TG.normalize(F.concat(F.coalesce("platform_tags", none), F.coalesce("terms", none))).alias("tags"), H.category_vote(H.tokens(F.col("plain"), stop)).alias("category"),
            H.type_vote(F.lower("plain"), has_article).alias("content_type"), H.entities(F.col("document"), F.col("author"), stop).alias("entities"), F.when(X.mostly_ascii(F.col("document")), "en").alias("language"),
            F.lit("heuristic").alias("mode"), F.lit("heuristic").alias("provider"), F.lit(None).cast("string").alias("model"), "source_hash", F.lit(1).alias("prompt_version"), F.lit(0).cast("bigint").alias("input_tokens"),
            F.lit(0).cast("bigint").alias("output_tokens"), F.lit(0.0).alias("cost_usd"), F.lit(0).cast("bigint").alias("duration_ms"), F.lit(True).alias("degraded"), note.alias("note"),
        )

    def backfill(self, limit: int = 50, upgrade_degraded: bool = True) -> DataFrame:
        """Enriches the first ``limit`` items that have no current enrichment or a degraded one."""
        env = self._document(self.envelopes.read()).withColumn("prompt_version", F.lit(1))
        enriched = self.enrichments.read() if upgrade_degraded else self.enrichments.read().withColumn("degraded", F.lit(False))
        todo = self._kept(S.backfill(env, enriched, "url_hash", limit, F.col("created_at")).select("url_hash"))
        return self.enrich(force=True, only=todo)

    def deepen(self, url: str) -> DataFrame:
        """Enriches one item anew with its media, whatever its text says; the item must be a video not seen yet."""
        one = U.with_canonical(self.spark.createDataFrame([(url,)], "url string")).select("url_hash")
        todo = self.envelopes.read().join(one, "url_hash", "left_semi").filter(E.can_deepen()).select("url_hash")
        return self.enrich(force=True, only=todo, mode="media")

    def index(self, force: bool = False, embed_chunks: bool = True) -> Report:
        """Indexes what changed, and its chunks and vectors with it."""
        o, report = self.options, Report()
        can_embed = embed_chunks and o.can_embed
        if embed_chunks and not o.can_embed:
            report.notes.append("embedding provider unavailable; indexed keyword-only")
        enr = self.enrichments.read().withColumnRenamed("source_hash", "_sh").drop("degraded", "note", "mode", "duration_ms", "platform")
        both = self.envelopes.read().join(enr, "url_hash", "left").withColumn("enriched", F.col("_sh").isNotNull()).withColumn("doc", E.search_document())
        both = both.withColumn("source_hash", C.fingerprint(F.col("doc"), F.col("summary"), F.coalesce("prompt_version", F.lit(0)), F.lit(o.model), F.lit(o.dim)))
        changed = S.changed(both, self.documents.read(), "url_hash", force=force)
        stale = changed.count()
        todo = self._kept(S.may_rewrite(changed, self.vectors.read(), "url_hash", can_embed))
        report.indexed = todo.count()
        report.skipped = self.envelopes.read().count() - stale + (stale - report.indexed)
        if stale > report.indexed:
            report.notes.append(f"{stale - report.indexed} changed items keep their chunks: their vectors cannot be made anew")
        fields = C.keyword_fields(F.col("enriched"))
        docs = todo.select("url_hash", "platform", "category", "content_type", *[c.alias(k) for k, c in fields.items()], "source_hash", "enriched", F.current_timestamp().alias("indexed_at"))
        self.documents.replace(docs)
        words, lengths = R.build_index(docs, "url_hash")
        self.postings.replace(words, docs)
        self.lengths.replace(lengths, docs)
        people = F.flatten(F.array(*[F.coalesce(F.col(f"entities.{k}"), F.array()) for k in ("people", "organizations", "places", "products")]))
        kind = F.when(F.col("enriched"), F.concat(F.col("category"), F.lit("; type: "), F.col("content_type")))
        head = C.digest(F.col("title"), F.col("summary"), F.col("description"), F.coalesce("tags", "platform_tags"), people, kind, F.col("author"), F.col("platform"), F.col("caption"))
        text = C.body(F.col("caption"), F.col("visual_description"), F.col("ocr_text"), F.col("transcript"), F.col("article_text"))
        made = self._kept(C.chunks(todo.select("url_hash", head.alias("head"), "details", text.alias("text")), "url_hash", "head", "details", "text"))
        self.chunks.replace(made, todo)
        report.chunks = made.count()
        if can_embed:
            # Also what an earlier run without an embedder, or another model, left without vectors.
            known = self.vectors.read().filter((F.col("model") == o.model) & (F.col("dim") == o.dim)).select("url_hash").distinct()
            bare = self.chunks.read().join(todo.select("url_hash"), "url_hash", "left_anti").join(known, "url_hash", "left_anti")
            new = self._kept(embed(made.unionByName(bare), ["url_hash", "ordinal"], "text", o.model, o.dim, o.embedder, skip_failures=True))
            bad = self._kept(new.filter("embedding IS NULL").select("url_hash").distinct())
            report.failed = bad.count()
            if report.failed:
                # One bad item does not stop the others; without any vector it is tried again by the next run.
                report.notes.append(f"{report.failed} items have no vectors: their embedding failed")
                new = new.join(bad, "url_hash", "left_anti")
            self.vectors.replace(new, todo.select("url_hash").unionByName(new.select("url_hash")))
            report.vectors = new.count()
        else:
            # Vectors of chunks that are no more would give hits with wrong texts.
            self.vectors.forget(todo.select("url_hash"))
        return report

    def forget(self, urls: DataFrame) -> None:
        """Removes urls(url) from every table."""
        gone = U.with_canonical(urls).select("url_hash").filter("url_hash IS NOT NULL")
        for t in (self.envelopes, self.enrichments, self.tag_rows, self.documents, self.chunks, self.vectors, self.postings, self.lengths):
            t.forget(gone)

    # -- jobs --------------------------------------------------------------------------

    def submit(self, urls: DataFrame) -> DataFrame:
        """A queued job for each of urls(url) that looks like an address; a job's id follows from its address."""
        new = urls.select("url").distinct().filter(U.looks_like_url(F.col("url"))).withColumn("job_id", F.xxhash64("url"))
        now = F.current_timestamp()
        new = self._kept(new.withColumns({"status": F.lit("queued"), "stage": F.lit("queued"), "error": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "created_at": now, "updated_at": now}))
        self.jobs.replace(new)
        return new

    def _move(self, jobs: DataFrame, **values) -> DataFrame:
        values = {k: v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string") for k, v in values.items()}
        out = self._kept(jobs.withColumns({**values, "updated_at": F.current_timestamp()}))
        self.jobs.replace(out)
        return out

    def run_jobs(self, pages: DataFrame | None = None) -> DataFrame:
        """Takes the queued jobs through extraction, enrichment and the index; their last states.

        pages(url and any of INPUTS) has what is known of the addresses; a stage that fails fails its jobs, not the library.
        """
        queued = self.jobs.read().filter("status = 'queued'")
        given = queued.select("url") if pages is None else queued.select("url").join(pages, "url", "left")
        stage, now = "extracting", self._move(queued, status="running", stage="extracting")
        try:
            new = self.add(given, force=True)
            for stage, step in (("enriching", lambda: self.enrich(only=new)), ("indexing", self.index)):
                now = self._move(now, stage=stage)
                step()
        except Exception as failure:
            return self._move(now, status="failed", stage=stage, error=f"{type(failure).__name__}: {str(failure)[:300]}")
        state = U.with_canonical(now).join(self.envelopes.read().select("url_hash", "degraded", "extractor_note"), "url_hash", "left")
        note = F.when(F.coalesce("degraded", F.lit(True)), F.col("extractor_note"))
        return self._move(state.withColumn("note", note).select(*now.columns), status="ready", stage="ready")

    def restart(self) -> DataFrame:
        """Jobs that were under way when the last process ended have failed."""
        cut = self.jobs.read().filter(F.col("status").isin("queued", "running"))
        return self.jobs.replace(self._kept(S.interrupted(cut)))

    def clear_jobs(self) -> int:
        """Removes finished jobs; how many."""
        done = self._kept(self.jobs.read().filter(F.col("status").isin("ready", "failed")).select("job_id"))
        self.jobs.forget(done)
        return done.count()

    # -- reading -----------------------------------------------------------------------

    def signatures(self) -> list[tuple[str, int, int]]:
        """(model, dim, vectors) of what is stored."""
        rows = self.vectors.read().groupBy("model", "dim").agg(F.count("*").alias("n")).orderBy("model", "dim").collect()
        return [(r["model"], r["dim"], r["n"]) for r in rows]

    def _vector_trouble(self) -> str | None:
        """Why there is nothing to compare a query vector with."""
        o, have = self.options, self.signatures()
        if any((m, d) == (o.model, o.dim) for m, d, _ in have):
            return None if o.can_embed else "embedding provider unavailable"
        if have:
            return f"no vectors for {o.model}@{o.dim}; index contains {', '.join(f'{m}@{d} ({n})' for m, d, n in have)}. Re-index."
        return "no vectors indexed yet; run index"

    def answer(self, text: str, query: list[float] | None = None, mode: str = "hybrid", limit: int = 10, tag: str | None = None, **equal) -> Answer:
        """A search with what there is to say about it; without usable vectors hybrid search falls back to keywords."""
        if mode not in ("hybrid", "keyword", "vector"):
            raise ValueError(f"unknown mode {mode!r}")
        text, notes, o = (text or "").strip(), [], self.options
        trouble = None if mode == "keyword" else self._vector_trouble()
        used = mode
        if not text:
            notes, used, query = ["empty query"], "keyword", None
        elif trouble:
            notes.append(trouble if mode == "vector" else f"{trouble}; keyword-only results")
            used = "keyword"
        docs = self.documents.read()
        if query is None and used != "keyword":
            one = embed(self.spark.createDataFrame([(0, text)], "k int, t string"), ["k"], "t", o.model, o.dim, o.embedder)
            query = [float(x) for x in one.first()["embedding"]]
        vectors = self.vectors.read().filter((F.col("model") == o.model) & (F.col("dim") == o.dim)).withColumn("chunk", F.col("ordinal"))
        hits = R.search(docs, vectors, "url_hash", "chunk", text, query, used, None, limit, docs, self.tag_rows.read(), tag, (self.postings.read(), self.lengths.read()), **equal)
        if mode == "vector" and used != mode:
            hits = hits.limit(0)  # a vector search answers with vectors or not at all
        out = R.hydrate(hits, docs.select("url_hash", "title", "summary", "tags", "platform", "category"), "url_hash")
        best = self.chunks.read().select("url_hash", F.col("ordinal").alias("chunk"), X.excerpt(F.col("text")).alias("excerpt"))
        return Answer(out.join(best, ["url_hash", "chunk"], "left").orderBy("position"), mode, notes, trouble is None)

    def search(self, text: str, query: list[float] | None = None, mode: str = "hybrid", limit: int = 10, tag: str | None = None, **equal) -> DataFrame:
        """Hits with their documents; a query vector of the provider's is made where none is given."""
        return self.answer(text, query, mode, limit, tag, **equal).hits

    def compare(self, text: str, limit: int = 10) -> DataFrame:
        return R.compare_modes({m: self.search(text, mode=m, limit=limit) for m in ("hybrid", "keyword", "vector")}, "url_hash")

    def items(self, limit: int = 200, offset: int = 0, after: tuple | None = None) -> DataFrame:
        """What is indexed, the latest first; after: indexed_at and url_hash of the last row of the page before."""
        if after is not None:
            return S.page_after(self.documents.read(), [("indexed_at", True), ("url_hash", False)], limit, after)
        return S.page(self.documents.read(), [F.desc("indexed_at"), F.asc("url_hash")], limit, offset)

    def item(self, url: str) -> DataFrame:
        """All that is known of one address: what is indexed, captured and understood."""
        key = U.with_canonical(self.spark.createDataFrame([(url,)], "url string")).select("url_hash")
        env = self.envelopes.read().select("url_hash", "canonical_url", "author", "caption", "signal", "tier", "degraded", "extractor_note", "media_kind", "duration_s", "platform_tags", "like_count", "view_count", E.coverage().alias("analysis"), E.can_deepen().alias("can_deepen"))
        enr = self.enrichments.read().select("url_hash", "details", "language", "mode", "provider", "model", "input_tokens", "output_tokens", "cost_usd", "note")
        return key.join(self.documents.read(), "url_hash").join(env, "url_hash", "left").join(enr, "url_hash", "left")

    def degraded(self, limit: int = 100) -> DataFrame:
        return self.envelopes.read().filter("degraded").orderBy("updated_at", "url_hash").limit(limit)

    def active_jobs(self) -> DataFrame:
        return S.open_jobs(self.jobs.read())

    def recent_jobs(self, limit: int = 20) -> DataFrame:
        return S.page(self.jobs.read(), [F.desc("created_at"), F.desc("job_id")], limit)

    def tiers_report(self) -> DataFrame:
        return T.tier_stats(self.attempts.read(), schema.TIERS)

    def summary(self) -> DataFrame:
        return T.library_summary(self.envelopes.read(), ["platform", "signal"], F.col("degraded"))

    def stats(self) -> dict[str, int]:
        """Counts of what is indexed."""
        docs = self.documents.read().agg(F.count("*"), F.sum(F.col("enriched").cast("int"))).first()
        return {"documents": docs[0], "enriched": docs[1] or 0, "chunks": self.chunks.read().count(), "vectors": self.vectors.read().count()}

    def tags(self, limit: int = 50) -> DataFrame:
        return T.top_values(self.tag_rows.read(), "tag", limit)

    def cost(self, by: str | None = None) -> DataFrame:
        return T.cost_summary(self.enrichments.read(), by)
