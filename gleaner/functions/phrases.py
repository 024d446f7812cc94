"""Phrase extraction: which taxonomy phrases does a text mention?

A phrase counts where it stands between word boundaries, ignoring case. Longer
phrases come first, and a match is dropped when it *starts* inside a span already
taken. One left-to-right scan with a longest-first pattern finds exactly these
phrases unless two phrases overlap in part in the text ("rest api" and
"api gateway" in "rest api gateway"). The texts in which that can happen are known
from the taxonomy alone; only the short segments that hold one of them are resolved
phrase by phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions.text import blank_if_null, let

_WORD = r"[\p{L}\p{N}_]"
# The phrases become one pattern held in the plan, so their number is a setting, not data;
# a larger taxonomy can be allowed with ``most``.
MOST_PHRASES = 20_000


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


@dataclass(frozen=True)
class Taxonomy:
    """Ordered ``(skill, category)`` pairs; a skill listed twice keeps its first category.

    ``edge="boundary"``: a phrase that begins or ends with a symbol needs a word
    character beside that symbol (regex ``\\b``). ``edge="token"``: no word character
    may stand on either side, so ``c++`` is found in ``C++ developer``.
    """

    entries: tuple[tuple[str, str], ...]
    edge: str = "boundary"
    most: int = MOST_PHRASES

    def __post_init__(self):
        if len(self.entries) > self.most:
            raise ValueError(f"taxonomy has {len(self.entries)} phrases, at most {self.most} were allowed")
        if self.edge not in ("boundary", "token"):
            raise ValueError(f"unknown edge rule {self.edge!r}")

    @classmethod
    def of(cls, categories: Mapping[str, Iterable[str]], edge: str = "boundary", exclude: Iterable[str] = ()):
        """From ``{category: [phrase, …]}``; phrases in ``exclude`` are left out."""
        skip = set(exclude)
        pairs = [(p, cat) for cat, phrases in categories.items() for p in phrases if p and p not in skip]
        return cls(tuple(pairs), edge)

    @classmethod
    def read(cls, spark: SparkSession, path: str, edge: str = "boundary", most: int = MOST_PHRASES):
        """From a CSV with header ``ord,skill,category``."""
        frame = spark.read.schema("ord int, skill string, category string").csv(path, header=True)
        rows = frame.orderBy("ord").limit(most + 1).collect()
        return cls(tuple((r["skill"], r["category"]) for r in rows), edge, most)

    @cached_property
    def skills(self) -> dict[str, str]:
        """Distinct skills in order, with their first category."""
        first: dict[str, str] = {}
        for skill, category in self.entries:
            first.setdefault(skill, category)
        return first

    @cached_property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(category for _, category in self.entries))

    @cached_property
    def by_priority(self) -> list[str]:
        return sorted(self.skills, key=len, reverse=True)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Dimension table ``(skill, category, category_ord)``."""
        rank = {c: i for i, c in enumerate(self.categories)}
        rows = [(s, c, rank[c]) for s, c in self.skills.items()]
        return spark.createDataFrame(rows, "skill string, category string, category_ord int")

    # -- patterns ---------------------------------------------------------

    def _before(self, phrase: str) -> str:
        symbol = self.edge == "boundary" and not _is_word(phrase[0])
        return f"(?<={_WORD})" if symbol else f"(?<!{_WORD})"

    def _after(self, phrase: str) -> str:
        symbol = self.edge == "boundary" and not _is_word(phrase[-1])
        return f"(?={_WORD})" if symbol else f"(?!{_WORD})"

    def phrase_pattern(self, phrase: str) -> str:
        return self._before(phrase) + _quote(phrase) + self._after(phrase)

    @cached_property
    def head_pattern(self) -> str:
        """The longest phrase at the start of a text, whose boundary before it is known to hold."""
        return "^(?:" + _prefix_pattern({p: self._after(p) for p in self.by_priority}) + ")"

    @cached_property
    def scan_pattern(self) -> str:
        """One pattern for all phrases; at each place the longest one wins."""
        groups: dict[str, list[str]] = {}
        for phrase in self.by_priority:
            groups.setdefault(self._before(phrase), []).append(phrase)
        # Looking at the first character is cheaper than looking at the boundary before it.
        return "|".join(
            f"(?=[{''.join(sorted({_quote(p[0]) for p in phrases}))}])"
            + before
            + _prefix_pattern({p: self._after(p) for p in phrases})
            for before, phrases in groups.items()
        )

    @cached_property
    def overlaps(self) -> list[str]:
        """Shortest texts in which two phrases (or one with itself) overlap in part."""
        starts: dict[str, list[str]] = {}
        for phrase in self.skills:
            for k in range(1, len(phrase)):
                starts.setdefault(phrase[:k], []).append(phrase)
        joined = set()
        for left in self.skills:
            for i in range(1, len(left)):
                shared = left[i:]
                for right in starts.get(shared, ()):
                    k = len(shared)
                    if self._fits(left[i - 1], right[0], right) and self._fits(right[k], left[-1], left):
                        joined.add(left + right[k:])
        return sorted(joined)

    def _fits(self, outside: str, edge_char: str, phrase: str) -> bool:
        # May the character `outside` stand next to this edge of the phrase?
        if self.edge == "boundary" and not _is_word(edge_char):
            return _is_word(outside)
        return not _is_word(outside)

    @cached_property
    def cut_pattern(self) -> str:
        """Characters that no phrase contains and that are no word characters."""
        used = sorted({ch for p in self.skills for ch in p if not _is_word(ch)})
        return r"[^\p{L}\p{N}_" + "".join("\\" + ch if not ch.isspace() else ch for ch in used) + "]+"


def _prefix_pattern(ends: Mapping[str, str]) -> str:
    """Alternation with shared prefixes factored out; longer phrases are tried first."""
    branches: dict[str, dict[str, str]] = {}
    stop = None
    for text, after in ends.items():
        if text:
            branches.setdefault(text[0], {})[text[1:]] = after
        else:
            stop = after
    options = [_quote(ch) + _prefix_pattern(rest) for ch, rest in sorted(branches.items())]
    if stop is not None:
        options.append(stop)
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def extract_skills(text: Column, taxonomy: Taxonomy) -> Column:
    """Distinct skills a text mentions, as an array."""
    if not taxonomy.entries:
        return F.array().cast("array<string>")
    low = F.lower(blank_if_null(text))
    scanned = _scan(low, taxonomy)
    if not taxonomy.overlaps:
        return scanned
    overlap = F.lit(_prefix_pattern({t: "" for t in taxonomy.overlaps}))

    def of_segments(marked: Column) -> Column:
        plain = F.array_join(F.transform(F.filter(marked, lambda m: ~m["tangled"]), lambda m: m["text"]), "\x01")
        tangled = F.filter(marked, lambda m: m["tangled"])
        return F.array_union(_scan(plain, taxonomy), F.flatten(F.transform(tangled, lambda m: _resolve(m["text"], taxonomy))))

    segments = F.split(low, taxonomy.cut_pattern)
    marked = F.transform(segments, lambda s: F.struct(s.alias("text"), F.rlike(s, overlap).alias("tangled")))
    return F.when(F.rlike(low, overlap), let(marked, of_segments)).otherwise(scanned)


def _scan(low: Column, taxonomy: Taxonomy) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(taxonomy.scan_pattern), F.lit(0)))


def _resolve(segment: Column, taxonomy: Taxonomy) -> Column:
    """Skills of a segment in which phrases overlap, in one pass from left to right.

    Whether a phrase counts depends only on phrases that begin before it and reach over its
    first letter: it does not if one of them that counts is longer, or as long and earlier in
    the taxonomy, or the same. Of phrases that begin together only the longest can count.
    So the pass keeps no more than the counted phrases that reach past the current place.
    """
    reach = max(map(len, taxonomy.skills))
    order = F.lit(taxonomy.by_priority)
    # Zero-width split: every piece but perhaps the first begins with a phrase.
    pieces = F.split(segment, "(?=" + taxonomy.scan_pattern + ")")

    def step(state: Column, at: Column) -> Column:
        def placed(text: Column) -> Column:
            size, begin = F.length(text), state["pos"]
            ahead = F.filter(state["spans"], lambda s: s["end"] > begin)
            earlier = lambda s: (s["text"] == text) | (F.array_position(order, s["text"]) < F.array_position(order, text))
            blocked = F.exists(ahead, lambda s: (F.length(s["text"]) > size) | ((F.length(s["text"]) == size) & earlier(s)))
            counts = (size > 0) & ~blocked
            span = F.struct(text.alias("text"), (begin + size).alias("end"))
            new = counts & ~F.array_contains(state["skills"], text)
            return F.struct(
                (begin + F.length(at["piece"])).alias("pos"),
                F.when(counts, F.array_append(ahead, span)).otherwise(ahead).alias("spans"),
                F.when(new, F.array_append(state["skills"], text)).otherwise(state["skills"]).alias("skills"),
            )

        return let(at["phrase"], placed)

    def phrases(all_pieces: Column) -> Column:
        def found(piece: Column, i: Column) -> Column:
            text = F.array_join(F.slice(all_pieces, i + 1, F.lit(reach + 1)), "")
            head = F.regexp_extract(text, taxonomy.head_pattern, 0)
            first = F.regexp_extract(text, "^(?:" + taxonomy.scan_pattern + ")", 0)
            return F.struct(piece.alias("piece"), F.when(i == 0, first).otherwise(head).alias("phrase"))

        return F.transform(all_pieces, found)

    start = F.struct(
        F.lit(0).alias("pos"), F.array().cast("array<struct<text:string,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("skills"),
    )
    return F.aggregate(let(pieces, phrases), start, step, lambda end: end["skills"])
