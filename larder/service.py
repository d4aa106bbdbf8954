"""The library as a service's functions: plain values in, plain values out, no transport.

Every answer is bounded by its limit.  A request that makes no sense raises ``BadRequest``, an item that is not there
``NotFound``; who may ask, and how often, is decided before (see ``operators.governor``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.engine import INPUTS, Library
from larder.functions import urls as U
from larder.operators.embedding import embed


class BadRequest(ValueError):
    pass


class NotFound(LookupError):
    pass


class Service:
    def __init__(self, library: Library):
        self.library, self.spark = library, library.spark

    def _page(self, url: str, **bodies):
        unknown = set(bodies) - set(INPUTS)
        if unknown:
            raise BadRequest(f"unknown inputs: {sorted(unknown)}")
        page = self.spark.createDataFrame([((url or "").strip(),)], "url string")
        if not page.select(F.coalesce(U.looks_like_url(F.col("url")), F.lit(False))).first()[0]:
            raise BadRequest("that does not look like a link; give a full address")
        return page.withColumns({k: F.lit(v).cast("string") for k, v in bodies.items()})

    def add_item(self, url: str, **bodies) -> dict:
        """Queues a link; run_jobs takes it further."""
        return self.library.submit(self._page(url, **bodies)).first().asDict()

    def items(self, limit: int = 200) -> list[dict]:
        if not 1 <= limit <= 1000:
            raise BadRequest("limit is 1 to 1000")
        return [r.asDict(recursive=True) for r in self.library.items(limit).collect()]

    def item(self, url: str) -> dict:
        row = self.library.item(url).first()
        if row is None:
            raise NotFound("unknown item")
        return row.asDict(recursive=True)

    def delete_item(self, url: str) -> None:
        self.library.forget(self._page(url))

    def deepen_item(self, url: str) -> int:
        """How many items were looked at again (none, if the picture was seen already)."""
        self.item(url)
        return self.library.deepen(url).count()

    def jobs(self, limit: int = 20) -> dict:
        rows = lambda df: [r.asDict() for r in df.limit(limit).collect()]
        return {"active": rows(self.library.active_jobs()), "recent": rows(self.library.recent_jobs(limit))}

    def clear_jobs(self) -> dict:
        return {"cleared": self.library.clear_jobs()}

    def search(self, q: str, mode: str = "hybrid", limit: int = 20, **filters) -> dict:
        if not 1 <= limit <= 100:
            raise BadRequest("limit is 1 to 100")
        try:
            a = self.library.answer(q, mode=mode, limit=limit, **filters)
        except ValueError as wrong:
            raise BadRequest(str(wrong)) from None
        return {"query": (q or "").strip(), "mode": a.mode, "vector_available": a.vector_available, "notes": a.notes, "hits": [r.asDict(recursive=True) for r in a.hits.collect()]}

    def stats(self) -> dict:
        o = self.library.options
        return {**self.library.stats(), "embed_model": o.model, "dimensions": o.dim, "vector_available": o.can_embed}

    def analyze(self, url: str, with_vectors: bool = True, **bodies) -> dict:
        """One link taken through all stages at once; what is known of it then."""
        lib, page = self.library, self._page(url, **bodies)
        new = lib.add(page, force=True)
        lib.enrich(only=new)
        lib.index(embed_chunks=with_vectors)
        out = self.item(url)
        if with_vectors:
            mine = lib.vectors.read().join(new.select("url_hash"), "url_hash", "left_semi").orderBy("ordinal")
            out["vectors"] = [[float(x) for x in r["embedding"]] for r in mine.collect()]
        return out

    def embed(self, texts: list[str]) -> dict:
        o = self.library.options
        rows = self.spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        made = {r["k"]: [float(x) for x in r["embedding"]] for r in embed(rows, ["k"], "t", o.model, o.dim, o.embedder).collect()}
        return {"model": o.model, "dim": o.dim, "vectors": [made[i] for i in range(len(texts))]}
