"""Pages that carry template residue, filler, error messages or calls for scripts instead of a programme's text."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.urls import canonical_url
from siftlake.llm.boilerplate import is_name
from siftlake.llm.lines import CONTENT, ERROR, FILLER, FURNITURE, LineModel, Scores
from siftlake.operators.joins import hot_join
from siftlake.session import cut

#: Canonical URLs on which a whole-page template must stand to count as repeated, sentences from which a page is a
#: programme's and its sentences are no message, and the margin of the classifier beyond which a label is the site's own.
REPEATED, FULL, FURNISHED = 5, 6, 2.0
#: The chance allowed for a programme's sentence to stand by accident on none of the fuller pages.
ACCIDENT = 1e-3
#: Frames that one further pass over the pages aligns; more frames take more passes.
BLOCK = 20_000
#: Pages whose lines are classified together.
SLICE = 250

# Forms of unfilled slots, defaults left in labelled fields, words of filler text, tags that are no slots.
SLOTS = (
    r"\{\{[^{}\n]+\}\}", r"\{%[^{}\n]+%\}", r"\$\{[^{}\n]+\}", r"\[\[[^\[\]\n]+\]\]", r"\[INSERT [^\[\]\n]+\]",
    r"<%[^<>\n]+%>", r"<\?(?:php|=)[^\n]+?\?>", r"%\([A-Za-z_][\w. ]*\)s", r"%%[A-Za-z_][\w. ]*%%", r"@@[A-Za-z_][\w. ]*@@",
    r"(?<!\w)__[A-Za-z][\w.]*?__(?!\w)", r"(?<![\w#&])#[A-Za-z_][\w.]*#(?!\w)", r"\[object Object\]",
)
LOOSE = (r"\{[A-Za-z_][\w. -]*\}", r"\[[A-Za-z_][\w. -]*\]", r"<[A-Z][A-Z_. ]+>")
DEFAULTS = r"(?:^|[:\-–]\s*)(?:Firstname Lastname|First Last|DD[/.-]MM[/.-]YYYY|YYYY-MM-DD|X{2,}(?:,X{2,})*(?: rupees)?|undefined|NaN)\s*\.?$|:\s*(?:NaN|undefined)\b|\bFirstname Lastname\b|\bX{2},X{3}\b"
#: Values that are a default only where other records fill the field.
WEAK = r"(?i:null|none|tbd|to be filled|0000-00-00|00[/.-]00[/.-]0000)\.?"
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit turpis lacus aliqua ornare morbi donec tortor varius felis velit quam mollis augue magna nulla vestib vestibulum sodal sodales sapien cursus purus eget nibh tempor incididunt labore et dolore sed do eiusmod".split())
TAGS = frozenset("BR B I P DIV SPAN UL LI A TD TR TABLE HR EM STRONG H1 H2 H3 NOSCRIPT SCRIPT HTML BODY HEAD".split())

_SLOT = re.compile("|".join(f"(?:{s})" for s in SLOTS))
_LOOSE = re.compile("|".join(f"(?:{s})" for s in LOOSE))
_DEFAULT = re.compile(DEFAULTS)
_MARKS = re.compile(r"[{}\[\]%@#<>]")
_HINTS = ("__", "XX", "DD/MM", "DD.MM", "DD-MM", "YYYY", "Firstname", "First Last", "undefined", "NaN")
_PLAIN = ("lorem", "ipsum", "dolor", "sapien", "tortor", "donec", "velit", "nulla", "morbi")
_ALMOST = (*_PLAIN, "ſ", "ı", "\u0307")
_LATIN = re.compile(rf"\b(?:{'|'.join(_PLAIN)})\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_WEAK = re.compile(WEAK)
_LABEL = re.compile(r"\s*([^\W\d_][^:.!?\n]*?)\s*:(?!//)\s*(.*?)\s*$")
_OPEN = re.compile(rf"(?m::[^\S\n]*(?:{WEAK}|[A-Za-z]\w*)?[^\S\n]*$)")
_FIRST, _LAST = re.compile(r"\W*([^\W\d_]+)(?![\w\0-\2])"), re.compile(r"(?<![\w\0-\2])([^\W\d_]+)\W*$")
_FRAME = re.compile(r"\d+|(?<![.!?] )(?<!^)\b[A-Z][\w'-]*(?: [A-Z][\w'-]*)*")
_ENDS = (". ", "! ", "? ", "। ", "… ")
_VARYING = re.compile(r"(?<!\S)[^\s\d]*\d\S*|(?<![\w-])[\w-]+(?:\.[\w-]+)+|(?<!^)\b[A-Z][\w'-]*(?: [A-Z][\w'-]*)*")
_INNER = re.compile(r"[^\W\d_][\w. >-]*")

#: Classes of lines in the order of their logits.
CLASSES = ("furniture", "content", "error", "filler")


@cache
def model() -> LineModel:
    """The classifier of lines with errors and filler as classes of their own."""
    return LineModel(dict(zip(CLASSES, (FURNITURE, CONTENT, ERROR, FILLER))))


def latin(text: str) -> bool:
    """Whether a text has a word of filler. Most texts are told by plain search; letters that only the pattern takes for i and s are left to it."""
    low = text.lower()
    return any(map(low.__contains__, _ALMOST)) and bool(_LATIN.search(text))


def hinted(text: str) -> bool:
    """Whether a text may have a mark or a default at all."""
    return bool(_MARKS.search(text)) or any(map(text.__contains__, _HINTS))


def masked(text: str) -> str:
    """A text in lower case with \\2 for names and figures."""
    return _FRAME.sub("\2", text).lower()


def slots(line: str, above: str = "") -> list[tuple[str, str, bool]]:
    """The unfilled slots of a line: its frame, the filler, and whether the form alone settles it.

    The frame is the slot's number and the line with \\1 for slots, names and figures masked; a line of slots alone has
    the masked line above it before it.
    """
    line = re.sub("[\0-\2]", "", " ".join(line.split()))
    sure = [m[0] for m in _SLOT.finditer(line)]
    rest = _SLOT.sub("\0", line)
    loose = [m[0] for m in _LOOSE.finditer(rest) if m[0][1:-1] not in TAGS]
    default = _DEFAULT.search(rest)
    if not (sure or loose or default):
        return []
    frame = masked(_LOOSE.sub(lambda m: m[0] if m[0][1:-1] in TAGS else "\1", rest))
    if not any(c.isalnum() for c in frame):
        frame = f"{above}\n{frame}"
    found, s, o = [], iter(sure), iter(loose)
    for i, c in enumerate(c for c in frame.rpartition("\n")[2] if c in "\0\1"):
        x = next(s if c == "\0" else o)
        found.append((f"{i} {frame}", x.lower(), c == "\0" or _settled(x)))
    if default:
        found.append((f"{len(found)} {frame}", default[0].lower(), True))
    return found


def _settled(mark: str) -> bool:
    """Whether a loose mark is a variable's by its form: no blank in braces or angles, capitals of a few words, a name with _ or a dot."""
    return mark[0] != "[" and " " not in mark or mark.isupper() and len(mark.split()) <= 5 or "_" in mark or bool(re.search(r"\w\.\w", mark))


class Reader:
    """Reads pages one after the other and keeps what it found out about lines that come again."""

    def __init__(self, scorer: LineModel):
        self.scores, self.seen, self.framed, self.numbered, self.tails = Scores(scorer), {}, {}, {}, {}

    def learn(self, raws: Iterable[str]) -> None:
        """Finds the classes of lines that are new; many at once take a fraction of the time that each alone takes."""
        if len(self.seen) >= 100_000:  # forgets, so that memory stays bounded
            self.seen.clear()
        self._tell(x for x in raws if x not in self.seen)

    def _tell(self, raws: Iterable[str]) -> None:
        rest, size = {}, 0
        for raw in raws:
            x = " ".join(raw.split())
            words = [w.lower() for w in _WORD.findall(x)] if latin(x) else []
            if len(words) >= 4 and sum(w in LOREM for w in words) > 0.6 * len(words):
                self.seen[raw] = "filler", 9.0
            elif is_name(x):
                self.seen[raw] = "name", 0.0
            else:
                rest[raw] = x
                size += len(x)
                if size > 1_000_000:
                    self._score(rest)
                    rest, size = {}, 0
        if rest:
            self._score(rest)

    def _score(self, lines: dict[str, str]) -> None:
        z = self.scores.of([*lines.values()])
        kinds = np.where(z.any(1), z.argmax(1), CLASSES.index("content"))
        margins = z[:, 2:].max(1) - z[:, :2].max(1)
        self.seen.update(zip(lines, zip(map(CLASSES.__getitem__, kinds.tolist()), margins.tolist())))

    def line(self, raw: str) -> tuple[str, float]:
        """Class of a line (name, heading, furniture, content, error, filler) and its margin over content. A line of unknown words alone is doubtful content."""
        if (got := self.seen.get(raw)) is None:
            self._tell([raw])
            got = self.seen[raw]
        return got

    def fields(self, lines: list[str]) -> Iterator[tuple[str, str]]:
        """Frame and value of labelled fields that are blank, keep a weak default or the name of their variable.

        A blank label has its value below it unless a label, furniture, a name or nothing comes next.
        """
        real = [" ".join(x.split()) for x in lines if x and not x.isspace()]
        for k, x in enumerate(real):
            if (m := _LABEL.match(x)) and len(m[1].split()) <= 8 and not ((got := self.line(f"{m[1]}:"))[0] == "furniture" and got[1] < -FURNISHED):
                label, value = m[1], m[2]
                name = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if re.fullmatch(r"[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+", value) else []
                if not value:
                    below = real[k + 1] if k + 1 < len(real) else None
                    unfilled = below is None or bool((n := _LABEL.match(below)) and len(n[1].split()) <= 8) or self.line(below)[0] in ("furniture", "name")
                else:
                    unfilled = bool(_WEAK.fullmatch(value)) or bool({*name} & {*_WORD.findall(label.lower())})
                if unfilled:
                    yield f"{masked(label)}: \1", value.lower()

    def frames(self, raw: str) -> tuple[tuple[int, int], ...]:
        """Numbers of the frames of a line's sentences, figures, names and addresses masked, and of the frames' last three words."""
        if (got := self.framed.get(raw)) is None:
            if len(self.framed) >= 100_000:
                self.framed.clear()
            x = " ".join(raw.split())
            for end in _ENDS:
                x = x.replace(end, f"{end[0]}\n")
            got = self.framed[raw] = tuple([self._numbers(s) for s in x.split("\n") if s])
        return got

    def _numbers(self, sentence: str) -> tuple[int, int]:
        """Numbers of a sentence's frame and of the frame's last three words."""
        if (got := self.numbered.get(sentence)) is None:
            if len(self.numbered) >= 100_000 or len(self.tails) >= 100_000:
                self.numbered.clear()
                self.tails.clear()
            frame = _VARYING.sub("\2", sentence).lower()
            if (got := self.tails.get(frame)) is None:
                got = self.tails[frame] = number(frame), number("\3" + " ".join(frame.split()[-3:]))
            self.numbered[sentence] = got
        return got

    def page(self, title: str | None, text: str | None) -> list[tuple[str, str, str, bool]]:
        """Evidence found on a page: kind (slot, field, filler, message), frame, filler, and whether its form alone settles it."""
        out = []
        if title and hinted(title):
            out += [("slot", *s) for x in title.split("\n") if hinted(x) for s in slots(x, "\ttitle")]
        if text and hinted(text):
            above = ""
            for x in text.split("\n"):
                if hinted(x):
                    out += [("slot", *s) for s in slots(x, masked(" ".join(above.split())))]
                if x and not x.isspace():
                    above = x
        if text and _OPEN.search(text):
            out += [("field", f"0 {frame}", filler, False) for frame, filler in self.fields(text.split("\n"))]
        return out

    def body(self, text: str | None) -> tuple[str, set[tuple[int, int]], int]:
        """What stands where a programme's text should: filler, message or nothing by the classifier; frames of all its sentences; their number."""
        kind, frames, programme, said, n = "", [], 0, -9.0, 0
        for raw in (text or "").split("\n"):
            if raw and not raw.isspace():
                got, margin = self.seen.get(raw) or self.line(raw)
                if got == "filler" and margin > 0:
                    kind = "filler"
                if got not in ("furniture", "name"):
                    mine = self.framed.get(raw) or self.frames(raw)
                    n += len(mine)
                    frames.append(mine)
                if got == "error":
                    said = max(said, margin)
                elif got == "content":
                    programme += 1
        if said > 0 and not programme:
            kind = kind or "message"
        return kind, {f for x in frames for f in x}, n


def number(text: str) -> int:
    """A text's number of 64 bits."""
    return struct.unpack("<q", blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


def plain(value: str) -> str:
    """The words of a slot's value or filler."""
    return " ".join(re.findall(r"[^\W_]+", value.lower()))


class Aligner:
    """Finds lines that fill the slots of given frames, two different values of each at most."""

    def __init__(self, frames: list[str]):
        self.first: dict[str, list[str]] = {}
        self.last: dict[str, list[str]] = {}
        self.below: dict[str, list[str]] = {}
        self.other: list[str] = []
        self.patterns: dict[str, re.Pattern] = {}
        self.slot: dict[str, int] = {}
        for key in frames:
            i, frame = key.split(" ", 1)
            above, sep, body = frame.rpartition("\n")
            self.slot[key] = int(i)
            self.patterns[key] = re.compile("".join("(.+?)" if x in "\0\1" else r"(?:\d+|[A-Z][\w'-]*(?: [A-Z][\w'-]*)*)" if x == "\2" else f"(?i:{re.escape(x).replace(':\\ ', r':\s?')})" for x in re.split("([\0\1\2])", body) if x))
            if sep:
                self.below.setdefault(above, []).append(key)
            elif m := _FIRST.match(body):
                self.first.setdefault(m[1], []).append(key)
            elif m := _LAST.search(body):
                self.last.setdefault(m[1], []).append(key)
            else:
                self.other.append(key)
        self.values: dict[str, set[str]] = {k: set() for k in frames}
        self.done: set[str] = set()

    def page(self, title: str | None, text: str | None) -> Iterator[tuple[str, str]]:
        if title and "\ttitle" in self.below:
            yield from self._match(" ".join(title.split()), self.below["\ttitle"])
        above = ""
        for raw in (text or "").split("\n") if len(self.done) < len(self.values) else ():
            if raw and not raw.isspace():
                keys = [*self.other]
                if self.first and (m := _FIRST.match(raw)):
                    keys += self.first.get(m[1].lower(), ())
                if self.last and (m := _LAST.search(raw)):
                    keys += self.last.get(m[1].lower(), ())
                if self.below:
                    keys += self.below.get(above, ())
                    above = masked(" ".join(raw.split()))
                if keys:
                    yield from self._match(" ".join(raw.split()), keys)

    def _match(self, line: str, keys: list[str]) -> Iterator[tuple[str, str]]:
        for key in keys:
            if key not in self.done and (m := self.patterns[key].fullmatch(line)):
                value = m[self.slot[key] + 1].strip()
                words = plain(value)
                if words and words not in self.values[key] and not (_SLOT.search(value) or _LOOSE.search(value) or _DEFAULT.search(line) or _WEAK.fullmatch(value)):
                    self.values[key].add(words)
                    if len(self.values[key]) > 1:
                        self.done.add(key)
                    yield key, words


def filled(rows: DataFrame, open_slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """frame, value of lines that fill the slots of open_slots' frames, by passes over the rows for `block` frames at a time.

    Frames are templates', not pages'; a pass holds a bounded number of them, and tasks give two values a frame at most.
    """
    frames = cut(open_slots.select("frame").distinct())
    n = frames.count()
    parts = max(1, -(-n // block))
    out = None
    for i in range(parts):
        sent = rows.sparkSession.sparkContext.broadcast([r.frame for r in frames.where(F.pmod(F.xxhash64("frame"), F.lit(parts)) == i).collect()] if n else [])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            aligner = Aligner(sent.value)
            for pdf in batches if sent.value else ():
                yield pd.DataFrame([(f, number(v)) for ti, te in zip(pdf["title"], pdf["text"]) for f, v in aligner.page(ti, te)], columns=["frame", "value"])

        got = rows.select("title", "text").mapInPandas(run, "frame string, value bigint") if n else rows.select(F.lit("").alias("frame"), F.lit(0).cast("bigint").alias("value")).limit(0)
        out = got if out is None else out.unionAll(got)
    return out


_FOUND = "page_id bigint, canon bigint, kind string, frame string, key bigint, value bigint, style bigint, sure boolean"


def evidence(pages: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """page_id, evidence: what shows that a page carries residue, a row for each kind of evidence that it has.

    Lines with a mark or default are aligned by their frame, the line with marks, names and figures masked.
    `slot`: the frame's slot holds different fillers over the pages, this one a variable's name or a default. `notation`:
    the frame is too rare for that, but marks of the same punctuation hold different names in different frames, so it is
    a template language's. `filled`: a loose mark (bracketed words), a blank label, a weak default or a name of a
    variable behind a label, whose frame another page fills with a value; where none does it is a blank meant for the
    reader. `form`: a mark of a template language that nothing can be aligned with.
    `template`: the page has no more than FULL - 1 sentences besides furniture, all of frames that stand on no fuller
    page (so none is a programme's) and on `repeated` canonical URLs each, or on more where fuller pages are so few that
    this could be by accident: a whole-page template, whatever its wording; the same holds for the frames' last three words. `filler` and `message`: filler lines, and messages without a line of programme text beside them, told by a
    small trained softmax.
    Null and empty texts have only their title; status_code plays no part. Only numbers, frames with marks and two
    values of an open frame and task are shuffled; a page of a hot template is joined by broadcast.
    """
    scorer = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(scorer)
        full: set[int] = set()
        for pdf in batches:
            rows, told = [], np.zeros(2, np.int64)
            for i, (p, u, ti, te) in enumerate(zip(pdf["page_id"], pdf["canon"], pdf["title"], texts := [*pdf["text"]])):
                if i % SLICE == 0:
                    reader.learn({x for t in texts[i : i + SLICE] if t for x in t.split("\n") if x and not x.isspace()})
                for k, frame, x, sure in dict.fromkeys(reader.page(ti, te)):
                    rows.append((p, u, k, frame, number(frame.replace("\0", "\1")), number(plain(x)), number(_INNER.sub("x", x)) if sure else 0, sure))
                kind, frames, n = reader.body(te)
                if kind:
                    rows.append((p, u, kind, "", 0, 0, 0, True))
                told += n >= FULL, n > 0
                if n >= FULL:
                    new = {f for pair in frames for f in pair} - full
                    full |= new
                    rows += [(0, 0, "full", "", f, 0, 0, True) for f in new]
                elif n:
                    whole = number(" ".join(map(str, sorted(frames))))
                    rows += [(p, u, "short", "", f, whole, tail, True) for f, tail in frames]
            rows.append((0, 0, "pages", "", *map(int, told), 0, True))
            if len(full) > 200_000:  # forgets, so that memory stays bounded
                full = set()
            yield pd.DataFrame(rows, columns=["page_id", "canon", "kind", "frame", "key", "value", "style", "sure"])

    rows = pages.select("page_id", F.xxhash64(canonical_url(F.coalesce("url", "final_url"))).alias("canon"), "title", "text").where("title is not null or text is not null")
    seen = cut(rows.mapInPandas(run, _FOUND))
    said = lambda df, kind: df.select("page_id", F.lit(kind).alias("evidence"))

    marks = seen.where("sure and kind = 'slot'")
    by = lambda *k: marks.groupBy(*k).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n"))
    aligned = hot_join(marks.select("page_id", "key", "style"), by("key").select("key", "n", (F.col("lo") != F.col("hi")).alias("slot")), "key")
    noted = hot_join(aligned, by("style").select("style", "n", ((F.col("lo") != F.col("hi")) & (F.col("a") != F.col("b"))).alias("notation")), "style")
    of_marks = noted.select("page_id", F.when(F.col("slot"), "slot").when(F.col("notation"), "notation").otherwise("form").alias("evidence"))

    unfilled = cut(seen.where("not sure").select("page_id", "frame", F.col("value").alias("filler")))
    fills = filled(rows, unfilled).distinct()
    sizes = unfilled.groupBy("frame").agg(F.count("*").alias("n"), F.min("filler").alias("lo"), F.max("filler").alias("hi"))
    some = fills.join(sizes, "frame").where("value <> lo or value <> hi").groupBy("frame").agg(F.max("n").alias("n"), F.min("value").alias("v"), F.max("value").alias("w"))
    of_fields = hot_join(unfilled, some, "frame").where("v <> filler or w <> filler")

    short = seen.where("kind = 'short'").select("page_id", "canon", "key", F.col("value").alias("whole"), "style")
    known = seen.where("kind = 'full'").select("key").distinct().withColumn("known", F.lit(True))
    fuller, every = seen.where("kind = 'pages'").agg(F.coalesce(F.sum("key"), F.lit(0)), F.coalesce(F.sum("value"), F.lit(0))).first()
    share = min(fuller / every, 0.999) if every else 0.0
    least = max(repeated, math.ceil(math.log(ACCIDENT) / math.log(1 - share))) if share else 1 << 62
    told = []
    for key in ("key", "style"):  # the frame itself, then its last words, which frames of one template share
        frames = short.select(F.col(key).alias("key"), "canon").distinct().groupBy("key").agg(F.count("*").alias("urls")).join(known, "key", "left")
        bodies = short.groupBy("whole", F.col(key).alias("key")).agg(F.count("*").alias("n"))
        by_body = bodies.join(frames, "key").groupBy("whole").agg(F.max("n").alias("n"), F.max(F.coalesce("known", F.lit(False))).alias("known"), F.min("urls").alias("urls"))
        told.append(by_body.where((F.col("urls") >= least) & ~F.col("known")).select("whole", "n"))
    templates = told[0].unionAll(told[1]).groupBy("whole").agg(F.max("n").alias("n"))
    of_templates = hot_join(short.select("page_id", "whole").distinct(), templates, "whole")

    by_class = seen.where("kind in ('filler', 'message')").select("page_id", F.col("kind").alias("evidence"))
    return of_marks.unionAll(said(of_fields, "filled")).unionAll(said(of_templates, "template")).unionAll(by_class).distinct()


def residue(pages: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """page_id of every page that has an unfilled slot (in text or title), filler, or a message in the programme's place; see evidence()."""
    return evidence(pages, repeated).select("page_id").distinct()
