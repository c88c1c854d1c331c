"""Variant spellings of the names of people and organisations.

Names are cut into tokens (folded accents, no titles, pronouns or addresses).
A symmetric-delete index finds tokens a small edit apart: a token, its long
forms and all of these with one letter less (two, from nine letters on) are
keys, names that share a key are candidates. Where many names share a key they
are candidates only if a second pair of their tokens may match as well, which
every match of such names needs. Each candidate pair is verified by the optimal
assignment of its tokens, which may pair equal tokens, typing errors, nicknames,
initials and abbreviations. Pairs whose tokens all match for certain join into
groups (with two typing errors or more unless both have a closer one); names with only an
initial (or without part of the name) join the one group they fit with the fewest
typing errors. The more names a table has, the more of them are a few letters
apart by chance. What kind of thing a name stands for is judged by its words, as
they occur in all names of a known type, and by legal forms.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.given_names import KNOWN
from palimpsest.operators.components import connected_components
from palimpsest.session import stored

#: A key of more than this many names is common: it finds candidates only together with a second key.
COMMON_NAMES = 60
#: A word tells a kind if the names of that kind with it exceed this share of all names with it and WORD_PRIOR more.
WORD_SHARE, WORD_PRIOR = 0.6, 2
#: Titles and what else is no part of a name.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "phd", "sir", "herr", "hr", "hrn", "frau", "fr", "mme", "mlle", "sra", "sr", "jr"}
#: Legal forms and their long names.
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "gmbh": "gmbh", "gesellschaftmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "sa": "sa", "societeanonyme": "sa", "sociedadanonima": "sa",
    "bv": "bv", "beslotenvennootschap": "bv", "plc": "plc", "nv": "nv", "spa": "spa", "srl": "srl",
}
#: Words that may be missing.
SMALL = {"the", "of", "and", "de", "la", "der", "die", "und", "et"}
#: Nicknames that are no beginning of the name they stand for.
NICKNAMES = {
    "abigail": "abby abbie", "alexander": "sasha alex", "andrew": "andy drew", "anthony": "tony", "barbara": "babs", "benjamin": "benny benji",
    "catherine": "kate kitty", "charles": "chuck charlie", "christopher": "kit topher", "daniel": "danny", "deborah": "debbie debby", "dmitri": "dima mitya",
    "dorothy": "dot dolly", "edward": "ted ned eddie", "eleanor": "ellie nell nellie", "elizabeth": "liz beth betty lisa", "francis": "frank",
    "frederick": "fred freddy", "harold": "hal harry", "henry": "hank harry", "isabella": "bella izzy", "james": "jim jimmy jamie", "jennifer": "jenny",
    "jessica": "jessie", "johannes": "hans", "john": "jack johnny jon", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "judith": "judy",
    "katherine": "kate kit kathy", "kenneth": "kenny", "lawrence": "larry", "leonard": "lenny", "margaret": "peggy maggie meg", "mary": "molly polly",
    "matthias": "matze", "michael": "mike mick misha", "nathaniel": "nate", "nicholas": "nick nico", "oksana": "ksenia", "patricia": "trish patty patsy",
    "patrick": "paddy", "philip": "phil pip", "rebecca": "becky becca", "richard": "dick rick", "robert": "bob bobby", "samantha": "sammy", "samuel": "sammy",
    "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy", "thomas": "tommy", "ursula": "uschi", "victoria": "vicky tori",
    "vincent": "vinny vinnie", "walter": "wally walt", "william": "bill will liam", "yelena": "lena", "zachary": "zack",
}
LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})
ADDRESS = re.compile(r"(<|mailto:|\S+\s*(?:@|\(at\)|\[at\]|＠)\s*\S+).*$", re.I | re.S)
#: The words of an address before its domain (and before a tag).
ACCOUNT = re.compile(r"[<\s:]*(?:mailto:)?\s*([^\s<>@＠+()\[\]]+)", re.I)
#: Vowels written as two letters for an accent.
SPELT = re.compile("(?<=[aou])e")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower()).translate(LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c))


def tokens(name: str | None) -> list[str]:
    """Tokens of a name; legal forms in one spelling, dotted capitals as one token if they are a legal form, else as initials."""
    text = fold(ADDRESS.sub("", re.sub(r"\([^)]*\)", " ", name or "")))
    text = re.sub(r"\bint['’]l\b", "international", text)
    parts = re.findall(r"[^\W_]+", text.replace("'", "").replace("’", ""))
    out: list[str] = []
    i = 0
    while i < len(parts):
        for n in (3, 2):  # written apart: s a, l l c, gesellschaft mbh
            joined = "".join(parts[i : i + n])
            if len(parts[i : i + n]) == n and joined in LEGAL and (len(parts[i]) == 1 or len(joined) > 6):
                out.append(LEGAL[joined])
                i += n
                break
        else:
            if parts[i] == "g" and parts[i : i + 4] == ["g", "m", "b", "h"]:
                out.append("gmbh")
                i += 4
                continue
            word = parts[i]
            out.append(LEGAL.get(word, word) if i else word)
            i += 1
    return initials([t for t in out if t not in TITLES], re.sub(r"\([^)]*\)", " ", name or ""))


def initials(words: list[str], name: str) -> list[str]:
    """Of several initials the first, the given name's; beside a single word, what the name's own e-mail address writes out for it."""
    first = next((i for i, t in enumerate(words) if len(t) == 1), None)
    long = [t for t in words if len(t) > 1]
    if first is None or not long:
        return words
    words = [t for i, t in enumerate(words) if len(t) > 1 or i == first]
    address = ADDRESS.search(name)
    account = ACCOUNT.match(address.group()) if address and len(long) == 1 else None
    for word in re.findall(r"[^\W\d_]{3,}", fold(account.group(1))) if account else ():
        if word[0] == words[first][0] and not long[0].startswith(word) and all(edits(w, long[0], 3) > 3 for w in (word, word[1:])):
            words[first] = word
            break
    return words


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with exchanges of neighbours, at most ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def is_short_for(a: str, b: str) -> bool:
    """Is ``a`` an abbreviation of ``b``: its letters in order, beginning with the first, and clearly fewer?"""
    if not (1 <= len(a) < len(b) and a[0] == b[0]) or len(b) < 5 or len(a) > len(b) - 1:
        return False
    rest = iter(b)
    return (b.startswith(a) or len(a) <= 5) and all(c in rest for c in a)


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment of all rows to different columns (at least as many columns as rows).

    Shortest augmenting paths with potentials, one row after another.
    """
    rows, columns = len(cost), len(cost[0])
    u, v = [0.0] * rows, [0.0] * columns
    owner = [-1] * columns
    for start in range(rows):
        least, came, seen = [math.inf] * columns, [-1] * columns, [False] * columns
        row, column, last = start, -1, -1
        while True:
            for j in range(columns):
                if not seen[j] and (gain := cost[row][j] - u[row] - v[j]) < least[j]:
                    least[j], came[j] = gain, last
            column = min((j for j in range(columns) if not seen[j]), key=least.__getitem__)
            step = least[column]
            u[start] += step
            for j in range(columns):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            seen[column], last = True, column
            if owner[column] < 0:
                break
            row = owner[column]
        while column >= 0:  # turn the path around
            before = came[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    out = [0] * rows
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


#: Known given names, folded.
GIVEN = {fold(n) for n in KNOWN}
#: What a pair that must not be costs; more than any assignment of possible pairs.
NEVER = 1e6
#: What a pair with so many typing errors costs (none: another spelling of an accent).
ERROR_COST = (0.15, 0.2, 0.25)


class Matcher:
    """Verifies pairs of names; ``alias`` has the full forms of short forms."""

    def __init__(self, alias: dict[str, set[str]]):
        self.alias = alias

    def cost(self, a: str, b: str, firm: bool) -> float | None:
        """What pairing two tokens costs, None if they do not match. From 0.5 on it is a match by an initial or abbreviation."""
        if a == b:
            return 0.0 if len(a) > 1 else 0.5
        fa, fb = self.alias.get(a, set()) | {a}, self.alias.get(b, set()) | {b}
        if fa & fb:
            return 0.1
        if len(a) == 1 or len(b) == 1:
            short, full = (a, b) if len(a) == 1 else (b, a)
            return 0.6 if full[0] == short and not firm else 0.3 if firm and is_short_for(short, full) else None
        n = min(len(a), len(b))
        most = 0 if n < 4 else 1 if n < 9 else 2
        if a in LEGAL or b in LEGAL:
            most = 0
        if most and (errors := edits(a, b, most)) <= most:
            return ERROR_COST[0 if SPELT.sub("", a) == SPELT.sub("", b) else errors]
        if not firm and n >= 3 and len(a) != len(b) and n <= 6 and (a.startswith(b) or b.startswith(a)):
            return 0.3
        if not firm and n >= 3:  # a nickname typed wrong
            if any(len(x) >= 5 and edits(x, y, 1) <= 1 for x in fa for y in fb):
                return 0.3
        if firm and (is_short_for(a, b) or is_short_for(b, a)):
            return 0.3
        return None

    def compare(self, left: list[str], right: list[str], firm: bool = False) -> int:
        """2: the same name for certain; 1: may be; 0: not (see ``weigh``)."""
        return self.weigh(left, right, firm)[0]

    def weigh(self, left: list[str], right: list[str], firm: bool = False) -> tuple[int, int]:
        """2: the same name for certain; 1: may be; 0: not; and the number of typing errors. ``firm``: one of the two is known to be an organisation's.

        Every token of the shorter name is paired with one of the longer, one of
        the pairs for certain (equal, or of five letters and not by an initial or
        abbreviation). Tokens that are left over cost more than any pair; whole
        words may not be left over where a word is paired with an initial (the
        initial of a middle name, beside another family name), nor may two words
        each be paired with the other name's initial unless both are given names.
        """
        form_a, form_b = {t for t in left if t in LEGAL}, {t for t in right if t in LEGAL}
        firm = firm or bool(form_a or form_b)
        if firm and form_a and form_b and not form_a & form_b:
            return 0, 0
        drop = SMALL | form_a | form_b if firm else set()
        a, b = [t for t in left if t not in drop], [t for t in right if t not in drop]
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 0, 0
        costs: list[list[float | None]] = []
        for x in a:
            costs.append([self.cost(x, y, firm) for y in b])
            if all(c is None for c in costs[-1]):
                return 0, 0
        best = (math.inf, 0, 0)
        spare = [[1.2 if len(y) > 1 else 0.2 for y in b]] * (len(b) - len(a))
        # either no whole word is left over, or no word is paired with an initial of the longer name
        for words_left in (False, True):
            table = [[NEVER if c is None or (words_left and len(x) > 1 and len(y) == 1) else c for y, c in zip(b, row, strict=True)] for x, row in zip(a, costs, strict=True)]
            table += [[c if words_left or c < 1 else NEVER for c in row] for row in spare]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    c = table[i][j]
                    if not (c < 0.3 and (min(len(x), len(y)) >= 5 or x == y)):
                        continue
                    # with this certain pair, the rest at the least cost
                    rest = [[z for k, z in enumerate(row) if k != j] for n, row in enumerate(table) if n != i]
                    chosen = assignment(rest) if rest else []
                    total = c + sum(row[k] for row, k in zip(rest, chosen, strict=True))
                    if total >= NEVER or total > best[0] + 1e-9:
                        continue
                    others = [y2 for k, y2 in enumerate(b) if k != j]
                    pairs = [(x, y, c)] + [(x2, others[k], rest[n][k]) for n, (x2, k) in enumerate(zip([t for n2, t in enumerate(a) if n2 != i], chosen, strict=False))]
                    # each name's word paired with the other's initial: given names may be, but no two family names
                    crossed = [[x2 for p, q, d in pairs for x2, y2 in ((p, q), (q, p))[k : k + 1] if d == 0.6 and len(x2) > 1 and len(y2) == 1] for k in (0, 1)]
                    if all(crossed) and not all(t in GIVEN for some in crossed for t in some):
                        continue
                    whole_left = any(len(others[k]) > 1 for k in chosen[len(a) - 1 :])
                    given = sum(1 for p, q, d in pairs if d < 0.5 and max(len(p), len(q)) > 1)
                    sure = not whole_left and given >= 2 and all(d < 0.5 or max(len(p), len(q)) == 1 for p, q, d in pairs)
                    errors = sum(ERROR_COST.index(d) for _, _, d in pairs if d in ERROR_COST)
                    best = min(best, (round(total, 6), -2 if sure else -1, errors))
        return -best[1], best[2]


def deletes(token: str) -> list[str]:
    """A token and its forms with one letter less."""
    return [token, *{token[:i] + token[i + 1 :] for i in range(len(token))}]


def token_keys(token: str, alias: dict[str, set[str]]) -> set[str]:
    """Keys of a token: two tokens that ``Matcher.cost`` takes as equal, nicknames or typing errors share one."""
    out: set[str] = set()
    for t in {token} | alias.get(token, set()):
        some = {t} if len(t) < 4 else set(deletes(t))
        out |= some if len(t) < 9 else {x for d in some for x in deletes(d)}
    return out


def second_keys(token: str, firm: bool) -> list[tuple[str, int]]:
    """Keys by which a token meets those it is short for, or that are short for it, with a side: 1 meets 2."""
    if len(token) == 1:  # an initial meets what begins with it, another initial too
        return [(f"i{token}", 1), (f"i{token}", 2)]
    out = [(f"i{token[0]}", 2)]
    if len(token) >= 3:  # a beginning
        out += [(f"p{token}", 1), *((f"p{token[:n]}", 2) for n in range(3, len(token)))]
    # an abbreviation, where one of the two names is a firm's
    if len(token) <= 5:
        out.append((f"{'a' if firm else 'f'}{token[0]}", 1))
    if len(token) >= 5:
        out += [(f"a{token[0]}", 2), *([(f"f{token[0]}", 2)] if firm else [])]
    return out


def candidates(forms: DataFrame, matcher: Matcher) -> DataFrame:
    """(a, b) with a < b: the ``fid`` of all pairs of names that ``Matcher.compare`` may accept, and others.

    ``forms``: (fid, parts, firm), stored. ``compare`` matches every token of the
    shorter name, one pair of them for certain, so the two names share a key of
    that pair. If the key is common, then a name of one word (legal forms and
    small words aside) meets all that have it; two longer names meet where
    another pair of their tokens shares a common key too, or may be a beginning,
    an initial or an abbreviation. A rare key of that pair finds them anyway.
    """

    def keyed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            found = [
                (f, i, k, sum(t not in SMALL and t not in LEGAL for t in parts) < 2)
                for f, parts in zip(pdf["fid"], pdf["parts"], strict=True)
                for i, t in enumerate(parts)
                if len(t) > 1 and (t not in LEGAL or len(parts) == 1)
                for k in token_keys(t, matcher.alias)
            ]
            yield pd.DataFrame(found, columns=["fid", "i", "key", "lone"])

    def seconds(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            found = [
                (f, j, k, side)
                for f, parts, firm in zip(pdf["fid"], map(list, pdf["parts"]), pdf["firm"], strict=True)
                for j, t in enumerate(parts)
                if t not in LEGAL
                for k, side in second_keys(t, firm)
            ]
            yield pd.DataFrame(found, columns=["fid", "j", "second", "side"])

    keys = forms.select("fid", "parts").mapInPandas(keyed, "fid long, i int, key string, lone boolean")
    keys = stored(keys.select("fid", "i", F.xxhash64("key").alias("key"), "lone"), "keys")
    common = keys.groupBy("key").agg(F.countDistinct("fid").alias("n")).filter(F.col("n") > COMMON_NAMES).select("key")
    common = stored(common, "common")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs of names on equal keys; hot keys are split by the adaptive join."""
        both = x.select("key", F.col("fid").alias("fx")).distinct().join(y.select("key", F.col("fid").alias("fy")).distinct(), "key").filter("fx <> fy")
        return both.select(F.least("fx", "fy").alias("a"), F.greatest("fx", "fy").alias("b"))

    rare = keys.join(common, "key", "left_anti").select("key", "fid").distinct()
    found = rare.withColumnRenamed("fid", "a").join(rare.withColumnRenamed("fid", "b"), "key").filter("a < b").select("a", "b")
    if common.isEmpty():
        return found.distinct()
    often = stored(keys.join(common, "key", "left_semi"), "often")
    some = forms.join(often.select("fid").distinct(), "fid", "left_semi").select("fid", "parts", "firm")
    second = some.mapInPandas(seconds, "fid long, j int, second string, side int").select("fid", "j", F.xxhash64("second").alias("second"), "side")
    second = second.unionByName(often.select("fid", F.col("i").alias("j"), F.col("key").alias("second"), F.lit(0).alias("side")))
    double = often.filter("NOT lone").join(second, "fid").filter("i <> j").select("fid", "side", F.xxhash64("key", "second").alias("key"))
    double = stored(double.distinct(), "double")
    both = double.filter("side = 0").select("key", "fid")
    found = found.unionByName(meet(often.filter("lone"), often))
    found = found.unionByName(both.withColumnRenamed("fid", "a").join(both.withColumnRenamed("fid", "b"), "key").filter("a < b").select("a", "b"))
    return found.unionByName(meet(double.filter("side = 1"), double.filter("side = 2"))).distinct()


def judged(named: DataFrame) -> DataFrame:
    """(form, parts, firm, person, other) of each spelling of ``named`` (kind, parts, form): what its words tell.

    A word tells a kind where names of that kind are more than WORD_SHARE of
    all names with it (and WORD_PRIOR others): legal forms count as the kind
    firm, names of unknown type only among all. Counted over all names and
    joined, so no list of words is collected.
    """
    legal = F.arrays_overlap("parts", F.array(*[F.lit(t) for t in sorted(set(LEGAL.values()))]))
    token = F.explode(F.array_distinct(F.filter("parts", lambda t: F.length(t) > 1))).alias("word")
    one = named.select(F.when(legal & (F.size("parts") > 1), "firm").otherwise(F.coalesce("kind", F.lit("none"))).alias("kind"), token)
    n = one.groupBy("word").agg(F.count("*").alias("n"), *[F.sum((F.col("kind") == k).cast("int")).alias(k) for k in KINDS])
    told = n.select("word", *[(F.col(k) > WORD_SHARE * (F.col("n") + WORD_PRIOR)).alias(k) for k in KINDS]).filter(" OR ".join(KINDS))
    forms = named.groupBy("form").agg(F.first("parts").alias("parts"))
    flags = forms.select("form", token).join(told, "word").groupBy("form").agg(*[F.max(k).alias(k) for k in KINDS])
    out = forms.join(flags, "form", "left")
    return out.select("form", "parts", (F.coalesce("firm", F.lit(False)) | legal).alias("firm"), *[F.coalesce(k, F.lit(False)).alias(k) for k in KINDS[1:]])


#: Kinds of things that names stand for.
KINDS = ["firm", "person", "other"]


def nearest(sure: DataFrame) -> DataFrame:
    """(src, dst): the pairs (a, b, errors) of one typing error at most, or of no more than any other pair of one of the two names has."""
    ends = sure.select(F.col("a").alias("fid"), "errors").unionByName(sure.select(F.col("b").alias("fid"), "errors"))
    least = stored(ends.groupBy("fid").agg(F.min("errors").alias("least")), "least")
    out = sure.join(least.select(F.col("fid").alias("a"), F.col("least").alias("p")), "a").join(least.select(F.col("fid").alias("b"), F.col("least").alias("q")), "b")
    return out.filter("errors <= 1 OR errors <= p OR errors <= q").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def link(entities: DataFrame, alias: DataFrame) -> DataFrame:
    """(id_a, id_b): entities whose names mean the same person or organisation, all pairs of a group.

    ``entities``: (id, name, kind), one row per id; ``kind`` is person, firm,
    other or null for unknown, as the unreliable type says. Those of another
    kind take part if their words tell a person or firm and none tells otherwise
    (names with digits do not). ``alias``: (short_form, full_form), a small
    fixed list and the only thing that is collected. Null and blank names match
    nothing; names of any length and number of words take part. Equal spellings
    are one candidate, however many entities have them. An empty table gives an
    empty result.
    """
    table: dict[str, set[str]] = {}
    for row in alias.dropna().collect():
        short, full = "".join(tokens("x " + row["short_form"])[1:]), "".join(tokens("x " + row["full_form"])[1:])
        if short and full:
            table.setdefault(short, set()).add(full)
    for full, shorts in NICKNAMES.items():
        for short in shorts.split():
            table.setdefault(short, set()).add(full)
    matcher = Matcher(table)

    @F.pandas_udf("array<string>")
    def cut(names: pd.Series) -> pd.Series:
        return names.map(lambda n: sorted(tokens(n)))

    named = entities.filter("trim(name) <> ''").select("id", "kind", cut("name").alias("parts"), F.col("name").rlike(r"\d").alias("digits"))
    named = stored(named.filter(F.size("parts") > 0).withColumn("form", F.concat_ws(" ", "parts")), "names")
    forms = stored(judged(named).withColumn("fid", F.monotonically_increasing_id()), "forms")
    strange = (F.col("kind") == "other") & (F.col("digits") | F.col("other") | ~(F.col("firm") | F.col("person")))
    named = named.join(forms.select("form", "fid", "firm", "person", "other"), "form").filter(~F.coalesce(strange, F.lit(False)))
    named = stored(named.select("id", "fid"), "named")
    forms = stored(forms.join(named.select("fid").distinct(), "fid", "left_semi").select("fid", "parts", "firm"), "forms")
    side = forms.select("fid", F.array_join("parts", " ").alias("form"), "firm")
    pairs = candidates(forms, matcher)
    pairs = pairs.join(side.select(F.col("fid").alias("a"), F.col("form").alias("x"), F.col("firm").alias("p")), "a")
    pairs = pairs.join(side.select(F.col("fid").alias("b"), F.col("form").alias("y"), F.col("firm").alias("q")), "b")

    @F.pandas_udf("grade int, errors int")
    def grade(x: pd.Series, y: pd.Series, firm: pd.Series) -> pd.DataFrame:
        found = [matcher.weigh(p.split(" "), q.split(" "), f) for p, q, f in zip(x, y, firm, strict=True)]
        return pd.DataFrame(np.array(found, np.int32).reshape(-1, 2), columns=["grade", "errors"])

    graded = stored(pairs.select("a", "b", grade("x", "y", F.col("p") | F.col("q")).alias("g")).select("a", "b", "g.grade", "g.errors").filter("grade > 0"), "graded")
    linked = connected_components(nearest(graded.filter("grade = 2")))
    whole = (F.size(F.filter("parts", lambda t: F.length(t) > 1)) >= 2).alias("whole")
    groups = forms.select("fid", whole).join(linked.select(F.col("node").alias("fid"), "component"), "fid", "left")
    groups = stored(groups.select("fid", F.coalesce("component", "fid").alias("component"), "whole"), "groups")
    # a group without a whole name, or a single name, joins the one other group that it may belong to
    about = groups.groupBy("component").agg(F.max("whole").alias("full"), F.count("*").alias("size"))
    g = stored(groups.select("fid", "component").join(about, "component"), "groups")
    may = graded.filter("grade = 1")
    may = may.select(F.col("a").alias("fid"), F.col("b").alias("other"), "errors").unionByName(may.select(F.col("b").alias("fid"), F.col("a").alias("other"), "errors"))
    own = g.filter("NOT full OR size = 1").select("fid", F.col("component").alias("own"))
    full = g.filter("full").select(F.col("fid").alias("other"), "component")
    fits = may.join(own, "fid").join(full, "other").filter("own <> component")
    fits = fits.groupBy("own", "component").agg(F.min("errors").alias("errors"))
    least = fits.groupBy("own").agg(F.min("errors").alias("errors"))
    joins = fits.join(least, ["own", "errors"]).groupBy("own").agg(F.count("*").alias("n"), F.min("component").alias("component")).filter("n = 1")
    merged = connected_components(joins.select(F.col("own").alias("src"), F.col("component").alias("dst")))
    member = named.join(g.select("fid", "component"), "fid").join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    member = member.select(F.coalesce("top", "component").alias("grp"), "id")
    many = member.groupBy("grp").count().filter("count > 1").select("grp")
    member = stored(member.join(many, "grp", "left_semi"), "members")
    x, y = member.withColumnRenamed("id", "id_a"), member.withColumnRenamed("id", "id_b")
    return x.join(y, "grp").filter("id_a < id_b").select("id_a", "id_b")
