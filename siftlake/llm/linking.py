"""Rows of one programme under differently typed names: exact radius joins in cells of a metric space."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.metric import radius_join
from siftlake.llm.names import Provider, alike, initials, programme, provider, same_provider, sounded
from siftlake.operators.joins import hot_join
from siftlake.session import cut

#: Edits by which two typed names of one thing may differ (an exchange of neighbours is one edit), and the radius of the
#: joins that find them, in which an exchange is two.
RADIUS, REACH = 2, 3

_SIGNATURE = "id bigint, sig string, space string, name string, own string, body string, letters string, short string, label string, known boolean, domain string"
_PARTS = ("sig", "space", "name", "own", "body", "letters", "short", "label", "known", "domain")


def _signatures(records: DataFrame) -> DataFrame:
    """id and the parts of each row's name and provider; sig, of 128 bits, numbers rows whose parts are the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[tuple[str, str | None], object] = {}
        for pdf in batches:
            out = []
            for i, name, typed, domain in zip(pdf["id"], pdf["name"], pdf["provider"], pdf["official_domain"]):
                if not isinstance(name, str) or not name.strip():
                    continue
                if len(names) > 100_000:
                    names.clear()
                typed = typed if isinstance(typed, str) else None
                if (q := names.get(("n", name))) is None:
                    q = names["n", name] = programme(name)
                if ("p", typed) not in names:
                    names["p", typed] = provider(typed)
                p = names["p", typed]
                domain = domain.strip().lower().removeprefix("www.") if isinstance(domain, str) else ""
                label = domain.split(".")[0] if p is None else ""
                parts = (f"{q.kind}|{q.level}" if q.kind else "", " ".join(q.name), " ".join(p.name) if p else "", p.body if p else "", p.letters if p else "", (p.letters or (initials(p) if p.body else "")) if p else "", label)
                text = "\x1f".join((*parts, "?" if p is None else "", str(i) if p is None and not q.kind else ""))
                out.append((i, blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), *parts, p is not None, domain))
            yield pd.DataFrame(out, columns=["id", *_PARTS])

    return records.where("id is not null").select("id", "name", "provider", "official_domain").mapInPandas(run, _SIGNATURE)


def _own_domains(rows: DataFrame) -> DataFrame:
    """The signatures, with no domain where most rows of that domain that name a provider are not of one organisation: an index of many."""
    label, own = F.split("domain", r"\.")[0], F.split("own", " ")
    typed = F.when(F.least(*[F.levenshtein(F.array_join(x, ""), label) for x in (own, F.reverse(own))]) <= RADIUS, "").otherwise(F.concat_ws("|", F.array_join(F.array_sort(own), " "), "body"))
    named = rows.where("known and letters = '' and domain <> ''").groupBy("domain", typed.alias("typed")).agg(F.count("*").alias("n"))
    index = named.groupBy("domain").agg(F.max("n").alias("most"), F.sum("n").alias("all")).where("2 * most < all").select("domain", F.lit("").alias("none"))
    return rows.drop("id").dropDuplicates(["sig"]).join(index, "domain", "left").withColumn("domain", F.coalesce("none", "domain")).drop("none")


def points_of(name: tuple[str, ...], letters: str = "") -> list[tuple[str, str, str, bool]]:
    """(suffix of the space, text, kind, initial) of the points at which a name stands.

    All as it is spelled and as it sounds. Kinds: `typed` as it stands, run together; `turned` with its two words
    exchanged, or its words in order where there are more; `word` in a space of its own for each initial: a name's other
    word, at which names with an initial and full names meet; `equal` where only equal texts meet: two initials with
    either first letter of a name, names with an initial by both first letters, acronyms by the letters of full names.
    """
    out = []
    for form in dict.fromkeys((name, sounded(name))):
        if form:
            out.append(("", "".join(form), "typed", False))
            turned = "".join(form[::-1] if len(form) == 2 else sorted(form))
            if turned != "".join(form):
                out.append(("", turned, "turned", False))
        if len(form) == 2:
            short = min(map(len, form)) == 1
            bare = max(map(len, form)) == 1
            out += [(f"|{x[0]}", y, "word", short) for x, y in (form, form[::-1]) if len(y) > 1 and (len(x) == 1 or not short)]
            out += [("|", x[0], "equal", bare) for x in form]
            if short:
                out.append(("|+", "".join(sorted(w[0] for w in form)), "equal", True))
    if letters:
        out.append(("|*", "".join(sorted(letters)), "equal", not name))
    return out


def near_names(names: DataFrame, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """space, a, b: every two names of one space that are within the radius of each other.

    names: space, key (what a and b are), name (its words), letters (of an acronym or of what one would be). The points
    of all names are joined within `reach` in their spaces by pivots; what meets is then measured word by word. Names with
    an initial meet full ones at the other word; such points are made only in spaces that hold an initial or acronym.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s + suffix, k, n, t, kind, initial) for s, k, n, le in zip(pdf["space"], pdf["key"], pdf["name"], pdf["letters"]) for suffix, t, kind, initial in points_of(tuple(n.split()), le)]
            yield pd.DataFrame(rows, columns=["space", "key", "name", "text", "kind", "initial"])

    points = cut(names.select("space", "key", "name", "letters").distinct().mapInPandas(place, "space string, key string, name string, text string, kind string, initial boolean"))
    whole = points.where("kind in ('typed', 'turned')")
    asked = points.where("initial").select("space").distinct()
    parts = cut(points.where("kind in ('word', 'equal')").join(asked, "space", "left_semi"))
    words, equal = parts.where("kind = 'word'"), parts.where("kind = 'equal'")
    met = radius_join(whole.select("space", "text").unionAll(words.select("space", "text")), reach)
    met = cut(met.unionAll(met.select("space", F.col("t").alias("s"), F.col("s").alias("t"))).unionAll(whole.unionAll(words).select("space", F.col("text").alias("s"), F.col("text").alias("t")).distinct()))

    def ends(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        side = lambda df, x: df.select(*on, F.col("key").alias(x), F.col("name").alias(f"of_{x}"))
        return side(left, "a").join(side(right, "b"), list(on)).select("a", "b", "of_a", "of_b")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        there = left.join(met.withColumnRenamed("s", "text"), ["space", "text"]).select("space", F.col("t").alias("text"), "key", "name")
        return ends(there, right, "space", "text")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [not x or not y or alike(tuple(x.split()), tuple(y.split()), radius) <= radius for x, y in zip(pdf["of_a"], pdf["of_b"])]
            yield pdf.loc[keep, ["a", "b"]]

    found = pairs(whole.unionAll(words.where("initial")), whole.unionAll(words)).unionAll(ends(equal.where("initial"), equal, "space", "text")).where("a <> b")
    turn = F.col("a") > F.col("b")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("of_b")).otherwise(F.col("of_a")).alias("of_a"), F.when(turn, F.col("of_a")).otherwise(F.col("of_b")).alias("of_b")).distinct()
    return found.mapInPandas(check, "a string, b string")


def _checked(pairs: DataFrame, parts: DataFrame, radius: int) -> DataFrame:
    """a, b, sure of the pairs of signatures whose names are alike and whose providers agree."""
    fields = [f for f in _PARTS if f != "sig"]
    side = lambda x: parts.select(F.col("sig").alias(x), F.struct(*fields).alias(f"of_{x}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["of_a"], pdf["of_b"]):
                if alike(tuple(x["name"].split()), tuple(y["name"].split()), radius) > radius:
                    continue
                p, q = (Provider(tuple(z["own"].split()), z["body"], z["letters"]) if z["known"] else None for z in (x, y))
                if p and q:
                    if same_provider(p, q, radius):
                        out.append((a, b, True))
                elif p or q or x["space"]:
                    label, other = (x["label"], q) if p is None else (y["label"], p)
                    sure = bool(other and label) and same_provider(Provider((label,), "", ""), other, radius)
                    if sure or x["space"]:
                        out.append((a, b, sure))
            yield pd.DataFrame(out, columns=["a", "b", "sure"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInPandas(check, "a string, b string, sure boolean")


def links(signatures: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b, sure: pairs of signatures whose names are within the radius in one space and whose providers agree.

    A space is a kind of award and level of study, which must be equal; in it founders' names are joined. A title without
    a kind is many providers', so titles are joined first, and then providers' names (without provider, the first label
    of the domain) in a space for each class of titles that hang together. sure is false where a provider is missing.
    Titles without provider at a domain that is one organisation's own are linked to the first of them there.
    """
    key = F.concat_ws("\x1f", "space", "name")
    named = cut(signatures.select("sig", "space", "name", key.alias("key")))
    met = cut(near_names(named.select("space", "key", "name", F.lit("").alias("letters")), radius))
    ends = lambda rows, near: rows.select(F.col("sig").alias("a_sig"), F.col("key").alias("a")).join(near, "a").join(rows.select(F.col("sig").alias("b_sig"), F.col("key").alias("b")), "b").select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))
    same = lambda rows: rows.select(F.col("key").alias("a"), F.col("key").alias("b")).distinct()
    kinds = named.where("space <> ''")
    pairs = ends(kinds, met.unionAll(same(kinds)))

    titles = signatures.where("space = ''").withColumn("key", key)
    group = components(met.join(titles.select(F.col("key").alias("a")).distinct(), "a", "left_semi")).withColumnRenamed("sig", "key")
    titled = cut(titles.join(group, "key", "left").withColumn("space", F.coalesce("class", "key")).drop("class", "key"))
    owners = titled.withColumn("owner", F.when(F.col("known") & (F.col("own") != ""), F.col("own")).otherwise(F.col("label")))
    of = cut(owners.where("owner <> '' or short <> ''").select("sig", "space", "owner", "short", F.concat_ws("\x1f", "space", "owner", "short").alias("key")))
    close = cut(near_names(of.select("space", "key", F.col("owner").alias("name"), F.col("short").alias("letters")), radius))
    more = ends(of, close.unionAll(same(of)))

    every = cut(pairs.unionAll(more).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone = titled.where("not known and domain <> ''").select("sig", "space", "domain")
    first = alone.groupBy("space", "domain").agg(F.min("sig").alias("a"))
    here = alone.join(first, ["space", "domain"]).where("a <> sig").select("a", F.col("sig").alias("b"), F.lit(True).alias("sure"))
    return _checked(every, signatures.select(*_PARTS), radius).unionAll(here).distinct()


def components(edges: DataFrame) -> DataFrame:
    """sig, class: the least signature that each end of an edge hangs together with, by rounds of taking the least neighbour's class."""
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class")))
    while True:
        seen = both.join(state.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("class").alias("near"))
        up = state.select(F.col("a").alias("class"), F.col("class").alias("root"))  # the class of one's class: halves the way
        moved = state.join(seen, "a").select("a", F.least("class", "near").alias("class"), F.col("class").alias("old")).join(up, "class", "left")
        moved = cut(moved.select("a", F.least("class", "root").alias("class"), "old"))
        if moved.where("class <> old").isEmpty():
            return state.select(F.col("a").alias("sig"), "class")
        state = moved.select("a", "class")


def classes(records: DataFrame, radius: int = RADIUS) -> DataFrame:
    """id, class of every named row: rows of the same programme have the same class (a programme alone is its own).

    Rows spelled alike share a signature and so a class, but for titles without provider, which are linked by their domain. A row without provider joins the class that its name and its
    address's domain lead to, or its name alone if that leads to one class only. Rows without name have no class.
    """
    rows = cut(_signatures(records))
    signatures = cut(_own_domains(rows))
    found = cut(links(signatures, radius))
    settled = components(found.where("sure"))
    label = signatures.select("sig", "known").join(settled, "sig", "left").select("sig", "known", F.coalesce("class", "sig").alias("class"), F.col("class").isNotNull().alias("settled"))
    loose = found.where("not sure")
    both = loose.select(F.col("a").alias("sig"), F.col("b").alias("other")).unionAll(loose.select(F.col("b").alias("sig"), F.col("a").alias("other")))
    lone = label.where("not known and not settled").select("sig")
    near = both.join(lone, "sig", "left_semi").join(label.select(F.col("sig").alias("other"), "known", "settled", F.col("class").alias("at")), "other")
    firm = F.col("known") | F.col("settled")
    told = near.groupBy("sig").agg(F.min(F.when(firm, F.col("at"))).alias("lo"), F.max(F.when(firm, F.col("at"))).alias("hi"), F.min(F.when(~firm, F.col("at"))).alias("peer"))
    to = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull() & F.col("peer").isNotNull(), F.least("peer", "sig"))
    final = label.join(told, "sig", "left").select("sig", F.coalesce(to, "class").alias("class"))
    return rows.select("id", "sig").join(final, "sig").select("id", "class")


def class_sizes(records: DataFrame) -> DataFrame:
    """id, class (the least id of the programme) and links (other rows of the same programme) of every named row."""
    c = cut(classes(records).distinct())
    size = c.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return hot_join(c, size.withColumn("links", F.col("n") - 1), "class").select("id", F.col("least").alias("class"), "links")


def same_programme(records: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b) of every two rows of the same programme, those spelled alike included."""
    c = cut(classes(records).distinct())
    return c.select("class", F.col("id").alias("id_a")).join(c.select("class", F.col("id").alias("id_b")), "class").where("id_a < id_b").select("id_a", "id_b")
