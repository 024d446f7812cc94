"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.common import packed, with_row_id
from gleaner.session import cut

#: Up to so many rules are looked up in a table that is part of the plan, row by row.
FEW_RULES = 500
#: More rules than this are joined by shuffle instead of being sent to every task.
BROADCAST_RULES = 50_000

_TOKEN = "[0-9A-Za-z\\x80-\\x{10FFFF}]+"
_TOKEN_PY = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Rule:
    """A regular expression over ``//host/path`` and the tokens that every match must hold whole."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, and paths that start with ``path``."""
    regex = f"^//([^/]*[.])?{_quote(host)}{_quote(path)}"
    return Rule(host + path, verdict, regex, _whole_tokens(f"//{host}{path}", open_end=True), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A pattern of literals: ``*`` any run, ``^`` a separator or the end, ``||`` the start of a host label, ``|`` an end."""
    body, start, end = pattern, "", ""
    if body.startswith("||"):
        body, start = body[2:], "^//([^/]*[.])?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    parts = {"*": ".*", "^": "([^0-9A-Za-z_.%-]|$)"}
    regex = start + "".join(parts.get(c) or _quote(c) for c in body) + end
    tokens: list[str] = []
    pieces = body.split("*")
    for i, piece in enumerate(pieces):
        first, last = i == 0, i == len(pieces) - 1
        text = ("/" if first and start else "") + piece.replace("^", "/") + ("/" if last and end else "")
        tokens += _whole_tokens(text, open_end=True, open_start=True)
    return Rule(pattern, verdict, "(?s)" + regex, tuple(tokens), False)


def _quote(literal: str) -> str:
    return re.sub(r"([^0-9A-Za-z/\x80-\U0010ffff])", r"\\\1", literal)


def _whole_tokens(text: str, open_end: bool = False, open_start: bool = False) -> tuple[str, ...]:
    """Tokens that cannot be part of a longer one in a matching URL."""
    found = list(_TOKEN_PY.finditer(text))
    return tuple(
        m.group() for m in found
        if not (open_start and m.start() == 0) and not (open_end and m.end() == len(text))
    )


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://`` or for null."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lowered).otherwise(""), F.when(has, path).otherwise("")


def _filed(tokens: DataFrame, rules: Sequence[Rule]) -> list[tuple]:
    """``(token, name, verdict, regex, listed, length)``: each rule under the one of its tokens that the fewest URLs hold.

    Only tokens of rules are counted. A rule without a token is filed under the empty token, which every URL has.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    held = tokens.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counts = dict(
        tuple(r) for r in tokens.join(_small(held, len(wanted)), "token", "left_semi").groupBy("token").count().collect()
    )
    return [
        (min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r.name, r.verdict, r.regex, r.listed, len(r.name))
        for r in rules
    ]


def _order(rule: Callable[[str], Column]) -> Column:
    """What makes a rule win: host rules first, then the longest, then those that block, then the name."""
    return F.struct(
        rule("listed").alias("listed"), rule("length").alias("length"), (rule("verdict") == "block").alias("blocks"),
        rule("name").alias("name"), rule("verdict").alias("verdict"),
    )


def _won(address: Column, tokens: Column, filed: list[tuple]) -> Column:
    """The winner among the rules that a row's tokens fetch and that fit; null if none does."""
    by_token: dict[str, list[tuple]] = {}
    for token, *rule in filed:
        by_token.setdefault(token, []).append(rule)
    names = ("name", "verdict", "regex", "listed", "length")
    entries = [
        F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in found]) for found in by_token.values()
    ]
    table = F.map_from_arrays(F.array(*map(F.lit, by_token)), F.array(*entries))
    known = F.filter(tokens, lambda t: t.isin(*by_token))
    fits = F.filter(F.flatten(F.transform(known, lambda t: table[t])), lambda r: F.rlike(address, r["regex"]))
    return F.array_max(F.transform(fits, lambda r: _order(lambda n: r[n])))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page: the ``carry`` columns in ``page``, host, path, rule, pattern, verdict.

    A URL's tokens fetch the rules filed under them and only those run their regular
    expression. Host rules (``listed``) go before patterns, then the longest rule wins, then
    block before allow, then the name. ``rule`` names a host rule, ``pattern`` a pattern.
    Without any fitting rule, as for a null URL or one without ``://``, the verdict is ``default``.
    Few rules are looked up within a row, and only their tokens are counted by a shuffle; more are joined.
    An empty table gives an empty result, and repeated rows are rows of their own.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(packed(carry).alias("page"), host.alias("host"), path.alias("path"))
    address = F.concat(F.lit("//"), "host", "path")
    own = F.array_append(F.array_distinct(F.regexp_extract_all(address, F.lit(_TOKEN), F.lit(0))), F.lit(""))
    if len(rules) <= FEW_RULES:
        filed = _filed(rows.select(F.explode(own).alias("token")), rules)
        won = _won(address, own, filed) if filed else F.lit(None).cast("struct<listed:boolean,length:int,blocks:boolean,name:string,verdict:string>")
        judged = rows.withColumn("won", won)
    else:
        narrow = with_row_id(rows, "urls")
        tokens = narrow.select("row", address.alias("address"), F.explode(own).alias("token"))
        schema = "token string, name string, verdict string, regex string, listed boolean, length int"
        index = pages.sparkSession.createDataFrame(_filed(tokens, rules), schema)
        fits = tokens.join(_small(index, len(rules)), "token").filter(F.expr("address rlike regex"))
        judged = narrow.join(cut(fits.groupBy("row").agg(F.max(_order(F.col)).alias("won")), "url-verdicts"), "row", "left")
    return judged.select(
        "page", "host", "path", F.when(F.col("won.listed"), F.col("won.name")).alias("rule"),
        F.when(~F.col("won.listed"), F.col("won.name")).alias("pattern"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )
