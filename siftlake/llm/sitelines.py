"""Lines that stand on many pages of one site, found by token trees of line templates."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.urls import canonical_url, host_of
from siftlake.session import cut

#: A template is excessive from so many pages of a site on, and from this share of them on. Levels of the trees above
#: their leaves, and the pages and templates from which a task starts new trees.
LEAST_PAGES, LEAST_SHARE, DEPTH, PART_PAGES, PART_TEMPLATES = 4, 0.3, 3, 5_000, 200_000

_DIGITS = re.compile(r"\d+")
SLOT = "<*>"


def _number(text: str) -> int:
    return struct.unpack("<q", blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


class TemplateTrees:
    """Token trees of fixed depth, one a site: the number of tokens, then the first tokens, then a leaf of templates.

    A run of digits in a token is a wildcard slot, which is all that lines of one template may differ in. Trees number
    their templates from 1 as they come; trees of different tasks are merged leaf by leaf, a template being the same
    where its leaf and the rest of its tokens are.
    """

    def __init__(self, depth: int = DEPTH):
        self.depth, self.roots, self.templates = depth, {}, []
        self.places: list[set[int]] = []
        self.seen: dict[tuple[object, str], int] = {}

    def parse(self, site: object, line: str, page: int = 0) -> int:
        """The number of a line's template in the tree of its site, where it is noted for the page; 0 for a blank line."""
        if (n := self.seen.get((site, line))) is None:
            n = self.seen[site, line] = self._insert(site, _DIGITS.sub(SLOT, line.lower()).split())
        if n:
            self.places[n - 1].add(page)
        return n

    def _insert(self, site: object, words: list[str]) -> int:
        if not words:
            return 0
        node = self.roots.setdefault(site, {}).setdefault(len(words), {})
        for w in words[: self.depth]:
            node = node.setdefault(w, {})
        rest = " ".join(words[self.depth :])
        if (n := node.get(rest)) is None:
            self.templates.append((site, _number(f"{len(words)} {' '.join(words[: self.depth])}"), _number(rest)))
            self.places.append(set())
            n = node[rest] = len(self.templates)
        return n


_ROW = "page_id bigint, known boolean, site bigint, canon bigint, part bigint, numbers array<int>, number int, leaf bigint, rest bigint, pages array<bigint>"


def page_trees(pages: DataFrame) -> DataFrame:
    """Rows of two kinds from one scan of page_id, known, site, canon, text: pages with the template numbers of their lines
    (numbers), and the templates of each part of the pages (number, leaf, rest) with the addresses they stand on (pages).

    A part is a stretch of a task's pages of bounded size with trees of its own; pages whose site is not known yet have
    trees of their address. Pages without text drop out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 32
        trees, held = TemplateTrees(), 0

        def templates() -> pd.DataFrame:
            roots = [r for r, _, _ in trees.templates]
            none = pd.Series([None] * len(roots), dtype=object)
            return pd.DataFrame({
                "page_id": none, "known": [r[1] is None for r in roots], "site": np.array([r[0] for r in roots], np.int64), "canon": np.array([r[1] or 0 for r in roots], np.int64), "part": task, "numbers": none, "number": np.arange(1, len(roots) + 1, dtype=np.int32),
                "leaf": np.array([x for _, x, _ in trees.templates], np.int64), "rest": np.array([x for _, _, x in trees.templates], np.int64), "pages": pd.Series([np.fromiter(p, np.int64, len(p)) for p in trees.places], dtype=object),
            })

        for pdf in batches:
            got = []
            for known, site, canon, text in zip(pdf["known"], pdf["site"], pdf["canon"], pdf.pop("text")):
                root = (site, None) if known else (site, canon)
                got.append(np.array([trees.parse(root, line, canon) for line in text.split("\n")], np.int32))
            yield pdf.assign(part=task, numbers=got, number=0, leaf=0, rest=0, pages=None)
            held += len(pdf)
            if held >= PART_PAGES or len(trees.templates) >= PART_TEMPLATES:
                yield templates()
                trees, held, task = TemplateTrees(), 0, task + 1
        yield templates()

    return pages.where("text is not null and text <> ''").mapInPandas(run, _ROW)


def _sited(pages: DataFrame) -> DataFrame:
    """page_id, site (of final_url, or else of url and not known), canon, text; sites and addresses as numbers."""
    canon = canonical_url(F.coalesce("url", "final_url"))
    host, own = host_of(F.col("final_url")), host_of(F.col("url"))
    return pages.where(canon.isNotNull()).select("page_id", host.isNotNull().alias("known"), F.xxhash64(F.coalesce(host, own)).alias("site"), F.xxhash64(canon).alias("canon"), "text")


def repeated_places(pages: DataFrame, candidates: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """page_id, places: the numbers (from 1) of the lines of a page whose template is excessive on its site.

    One scan of the texts. The trees of all parts are merged by counting each template's distinct addresses over them;
    what is excessive goes back to the parts as their own template numbers, and each part, which is of bounded size
    whatever the size of its sites, marks its pages. Only numbers are shuffled.
    """
    seen = cut(page_trees(_sited(pages)))
    unknown = seen.where("not known")
    domain = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    given = candidates.where("domain is not null").select(F.xxhash64("canonical_url").alias("canon"), domain.alias("given")).join(unknown.select("canon").distinct(), "canon", "left_semi")
    known = given.groupBy("canon").agg(F.xxhash64(F.min("given")).alias("given"))
    rows = seen.where("known").unionByName(unknown.join(known, "canon", "left").withColumn("site", F.coalesce("given", "site")).drop("given"))
    rows = rows.withColumn("t", F.xxhash64("site", "leaf", "rest"))

    templates = rows.where("number > 0").select("part", "number", "site", "t", "pages")
    texts = rows.where("number = 0 and exists(numbers, n -> n > 0)").select("site", "canon").distinct().groupBy("site").agg(F.count("*").alias("n"))
    counted = templates.select("site", "t", F.explode("pages").alias("canon")).distinct().groupBy("t").agg(F.first("site").alias("site"), F.count("*").alias("k")).where(F.col("k") >= least)
    excessive = counted.join(texts, "site").where(F.col("k") >= share * F.col("n") - 1e-9).select("t")
    bad = templates.select("part", "number", "t").join(excessive, "t").select((F.col("part") + 0).alias("of"), "number")
    return seen.where("number = 0").select("part", "page_id", "numbers").groupBy("part").cogroup(bad.groupBy("of")).applyInPandas(_marked, "page_id bigint, places array<int>")


def _marked(pages: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
    """The pages of one part with the places of its bad templates; pages without any drop out."""
    sizes = np.array([len(n) for n in pages["numbers"]], np.int64)
    numbers = np.concatenate([*pages["numbers"], np.zeros(0, np.int32)])
    flag = np.zeros(max(numbers.max(initial=0), bad["number"].max() if len(bad) else 0) + 1, bool)
    flag[bad["number"]] = True
    ends = np.cumsum(sizes)
    at = np.flatnonzero(flag[numbers])
    owner = np.searchsorted(ends, at, "right")
    line = (at - (ends - sizes)[owner] + 1).astype(np.int32)
    rows, starts = np.unique(owner, return_index=True)
    return pd.DataFrame({"page_id": pages["page_id"].to_numpy()[rows], "places": pd.Series(np.split(line, starts[1:]) if len(rows) else [], dtype=object)})


def repeated_lines(pages: DataFrame, candidates: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """page_id, line_no of every non-blank line whose template is excessive on its site, over all runs.

    A site is the host of final_url in lower case without www., where that is null the domain that the candidates give
    for the canonical URL (the least of several), or else the host of url. A template is excessive if it stands on at
    least `least` of the site's canonical URLs and on at least `share` of those that have any non-empty text. Pages
    without any address, and those without text, have no rows.
    """
    return repeated_places(pages, candidates, least, share).select("page_id", F.explode("places").alias("line_no"))


def without_repeated_lines(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """page_id and text of every page with its excessive lines taken out; a null text stays null."""
    bad = repeated_places(pages, candidates).groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("bad"))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains("bad", i + 1), x)), lambda x: x.isNotNull())
    return pages.select("page_id", "text").join(bad, "page_id", "left").select("page_id", F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
