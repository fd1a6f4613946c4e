"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

The same entity gets the same surrogate everywhere (coreference), different entities get different
ones (distinctness), and no surrogate is itself an entity of the corpus.  A keyed generator makes the
first proposal in the tasks; proposals of all distinct entities are then checked against each other
and against the originals, and the losers of a clash try again until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

# Titles that announce a name, with the gender they tell, and given names by gender.
TITLES = {
    "Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Dr.": "x", "Prof.": "x",
    "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
    "Señor": "m", "Señora": "f", "Sr.": "m", "Sra.": "f", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f",
}
GIVEN = {
    ("m", "latin"): "adam albert anton ben boris carl daniel david emil felix georg hugo ivan james jonas karl leo lucas mark martin nils oscar paul peter robert simon thomas victor".split(),
    ("f", "latin"): "alice anna bella clara diana elena emma eva flora grace helen ida irene jane julia karin laura lena maria marta nina olga paula rosa sara sofia teresa vera".split(),
    ("m", "cyrillic"): "андрей борис виктор денис егор иван игорь кирилл максим никита олег павел роман сергей фёдор юрий".split(),
    ("f", "cyrillic"): "алина анна вера галина дарья елена зоя ирина лариса мария нина ольга полина раиса софья юлия".split(),
}
_GENDER = {name: gender for (gender, _), names in GIVEN.items() for name in names}
# Mail domains so many people share that they tell nobody, words before a top-level
# domain that belong to it, and phrases that announce a name.
PROVIDERS = set("gmail.com googlemail.com yahoo.com outlook.com hotmail.com live.com icloud.com aol.com proton.me gmx.de gmx.net web.de t-online.de orange.fr free.fr laposte.net mail.ru yandex.ru example.com example.org example.net".split())
_SECOND_LEVEL = set("ac co com edu gov net org".split())
_PHRASE = r"[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут"
_SYLLABLES = {
    "latin": "ba be bor da del dor fa fen gar gol ha hol ka kel kor la len lor ma mer mon na nel nor pa per ra ren ros sa sel sor ta tel tor va ven vor wa wel wor za zel".split(),
    "cyrillic": "ба бел бор ва вер вол га гор да дел дор за зел ка ков кор ла лев лок ма мел мор на нев нор па пер ра род са сев сор та тел тор фа хар ча шев".split(),
    "greek": "αλ βα γε δη ελ ζα θε κα λε μα νι ξε πα ρο σα τε φω χα".split(),
}
_TITLE = "|".join(sorted((re.escape(t) for t in TITLES), key=len, reverse=True))
_NAME = r"[^\W\d_][^\W\d_'’-]*"
_KNOWN = "|".join(sorted({n.capitalize() for names in GIVEN.values() for n in names}))
_SECRET = r"(?:password|passwd|token|api_key)(?:=|[ \t]*=(?!=)[ \t]*)"
_TRIGGER = re.compile(rf"[0-9@]|AKIA|{_SECRET}|\b(?:{_TITLE}|{_PHRASE})\s|(?=[A-ZА-ЯЁ])\b(?:{_KNOWN}) [^\W\d_a-z]")
_WORD = re.compile(r"\b[^\W\d_]+\b")
_PLAIN = re.compile(r"(?P<key>AKIA[A-Z0-9]{16})|(?P<hash>(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64})")
_FIND = re.compile(
    "|".join(
        [
            r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
            r"(?P<key>\bAKIA[A-Z0-9]{16}\b)",
            rf"{_SECRET}(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|(?P<secret>\S+))",
            r"(?P<hash>\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}\b)",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))",
            r"(?P<card>(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-]))",
            r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
            r"(?P<phone>(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d))",
            rf"(?=[A-ZА-ЯЁijmгм])(?P<title>\b(?:{_TITLE}|{_PHRASE})\s+)(?P<first>{_NAME})(?:(?P<gap>[ ])(?P<last>{_NAME}))?",
            rf"(?=[A-ZА-ЯЁ])\b(?P<given>(?:{_KNOWN})) (?P<name>(?:[^\W\d_]\. )?[^\W\d_a-z][^\W\d_'’-]*[^\W\d_])",
        ]
    )
)


def script_of(word: str) -> str:
    """Script of the first letter: latin, cyrillic or greek; latin for any other."""
    code = ord(word[0])
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else "latin"


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, type, entity)`` in text order; ``entity`` is the mention without its format.

    A title, or a phrase such as "my name is", followed by two capitalised words is a given name and
    a surname, by one a surname; a common given name and a capitalised word behind it (perhaps
    after an initial) are a name without a title.
    Names count word by word, so a mention by surname alone is the same entity; once a name is
    found, its other capitalised mentions in the text count without a title too.  A secret may stand
    in quotes, which aren't part of it.
    """
    if not _TRIGGER.search(text):
        return []
    found = []
    names: dict[str, str] = {}
    for m in _FIND.finditer(text):
        if m["title"]:
            first, last = m["first"], m["last"]
            if not first[0].isupper():
                continue
            if last and last[0].isupper():
                gender = TITLES.get(m["title"].strip(), "x")
                gender = _GENDER.get(first.lower(), "m") if gender == "x" else gender
                found.append((*m.span("first"), f"given {gender} {script_of(first)}", first.lower()))
                found.append((*m.span("last"), f"surname {script_of(last)}", last.lower()))
            else:
                found.append((*m.span("first"), f"surname {script_of(first)}", first.lower()))
            continue
        if m["given"]:
            first, last = m["given"], m["name"].split(" ")[-1]
            if last[0].isupper():
                found.append((*m.span("given"), f"given {_GENDER[first.lower()]} {script_of(first)}", first.lower()))
                found.append((m.end("name") - len(last), m.end("name"), f"surname {script_of(last)}", last.lower()))
            continue
        kind = m.lastgroup
        start, end = m.span(kind)
        mention = m[kind]
        if kind == "secret":
            mention = mention.rstrip(".,;")
            end = start + len(mention)
        if kind in ("secret", "double", "single"):
            plain = _PLAIN.fullmatch(mention)
            kind = plain.lastgroup if plain else "secret"
        if kind in ("card", "ssn", "phone"):
            entity = re.sub(r"\D", "", mention)
        else:
            entity = mention.replace(" ", "") if kind == "iban" else mention.lower() if kind == "email" else mention
        if entity:
            found.append((start, end, kind, entity))
    for _, _, kind, entity in found:
        if kind.startswith(("given", "surname")):
            names.setdefault(entity, kind)
    if names:
        found += _bare_names(text, names, found)
        found.sort()
    return found


def _bare_names(text: str, names: dict[str, str], found: list) -> list[tuple[int, int, str, str]]:
    """Capitalised mentions of ``names`` outside the spans ``found``, which are in text order."""
    out, k = [], 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while k < len(found) and found[k][1] <= start:
            k += 1
        if (k == len(found) or found[k][0] >= end) and m[0][0].isupper() and m[0].lower() in names:
            out.append((start, end, names[m[0].lower()], m[0].lower()))
    return out


def _stream(secret: bytes, *parts: str) -> Iterator[int]:
    """Endless keyed numbers below 2**32."""
    counter = 0
    while True:
        block = hmac.digest(secret, "\x1f".join((*parts, str(counter))).encode("utf-8", "surrogatepass"), hashlib.sha256)
        for i in range(0, 32, 4):
            yield int.from_bytes(block[i : i + 4], "big")
        counter += 1


def _same_shape(text: str, numbers: Iterator[int]) -> str:
    """Digits for digits, small letters for small letters, capitals for capitals, the rest as it is."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(chr(48 + next(numbers) % 10))
        elif "a" <= c <= "z":
            out.append(chr(97 + next(numbers) % 26))
        elif "A" <= c <= "Z":
            out.append(chr(65 + next(numbers) % 26))
        else:
            out.append(c)
    return "".join(out)


def _hex_shape(text: str, numbers: Iterator[int]) -> str:
    return "".join(
        chr(48 + next(numbers) % 10) if c.isdigit() else "abcdef"[next(numbers) % 6] if c in "abcdef" else c for c in text
    )


def _luhn_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_digits(country: str, body: str) -> str:
    """The two check digits of an IBAN: 98 less the remainder by 97, letters counting from 10."""
    digits = "".join(str(int(c, 36)) for c in body + country) + "00"
    return f"{98 - int(digits) % 97:02d}"


def _domain(secret: bytes, domain: str) -> str:
    """The surrogate of a mail domain: that of a provider stays, under any other every label but the
    top level is replaced, the same way in all addresses."""
    labels = domain.split(".")
    kept = 2 if ".".join(labels[-2:]) in PROVIDERS or (len(labels) > 2 and labels[-2] in _SECOND_LEVEL) else 1
    numbers = _stream(secret, "domain", domain)
    return ".".join([*(_same_shape(x, numbers) for x in labels[:-kept]), *labels[-kept:]])


def propose(secret: bytes, kind: str, entity: str, attempt: int) -> str:
    """The surrogate of ``entity`` at its ``attempt``-th try, in the entity's own normal form.

    From the eighth try on a short entity may grow by a letter or digit, so that a crowded format
    can't run out of surrogates.
    """
    numbers = _stream(secret, kind, entity, str(attempt))
    more = attempt // 8
    if kind.startswith("given"):
        _, gender, script = kind.split()
        pool = GIVEN.get((gender, script))
        name = pool[next(numbers) % len(pool)] if pool else _surname(script, numbers, 2)
        # Further names continue the pool in the same gender as double names.
        for _ in range(0 if attempt < 2 else 1 + more):
            name += ("-" + pool[next(numbers) % len(pool)]) if pool else _surname(script, numbers, 1)
        return name
    if kind.startswith("surname"):
        return _surname(kind.split()[1], numbers, 3 + more)
    if kind == "email":
        local, _, domain = entity.partition("@")
        return _same_shape(local + "x" * more, numbers) + "@" + _domain(secret, domain)
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        octets = []
        for part in entity.split("."):
            low, high = ranges[len(part) if not more else 3]
            octets.append(str(low + next(numbers) % (high - low + 1)))
        return ".".join(octets)
    if kind == "card":
        body = entity[0] + _same_shape(entity[1:-1], numbers)
        real = _luhn_digit(entity[:-1]) == entity[-1]
        return body + (_luhn_digit(body) if real else str(next(numbers) % 10))
    if kind == "phone":
        keep = len(entity) - 10 if len(entity) > 10 else 0
        own = list(_same_shape(entity[keep:], numbers))
        for k in (0, 3):  # area and exchange codes don't start with 0 or 1
            if k < len(own) and own[k] in "01":
                own[k] = str(2 + next(numbers) % 8)
        return entity[:keep] + "".join(own)
    if kind == "hash":
        return _hex_shape(entity, numbers)
    if kind == "key":
        return entity[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[next(numbers) % 32] for _ in entity[4:])
    if kind == "iban":
        body = _same_shape(entity[4:], numbers)
        return entity[:2] + (_iban_digits(entity[:2], body) if _iban_digits(entity[:2], entity[4:]) == entity[2:4] else _same_shape(entity[2:4], numbers)) + body
    if kind == "secret":
        shape = _hex_shape if re.fullmatch(r"[0-9a-f]+", entity) else _same_shape
        return shape(entity + "a" * more, numbers)
    return _same_shape(entity + "0" * more, numbers)


def _surname(script: str, numbers: Iterator[int], syllables: int) -> str:
    pool = _SYLLABLES[script]
    return "".join(pool[next(numbers) % len(pool)] for _ in range(syllables))


def in_format(mention: str, kind: str, surrogate: str) -> str:
    """``surrogate`` written as ``mention`` was: its separators, or its case for names and emails."""
    if kind in ("card", "ssn", "phone", "iban"):
        letters = iter(surrogate)
        out = "".join(next(letters, "") if c.isalnum() else c for c in mention)
        return out + "".join(letters)
    if kind == "email" or kind.startswith(("given", "surname")):
        if mention.isupper() and len(mention) > 1:
            return surrogate.upper()
        if kind != "email" or mention.istitle():
            return re.sub(r"(^|-)(\w)", lambda m: m[1] + m[2].upper(), surrogate)
    return surrogate


def replace_entities(text: str, surrogate) -> tuple[str, int]:
    """The text with every mention replaced by ``surrogate(type, entity)``, and the number of mentions."""
    out, at, found = [], 0, find_entities(text)
    for start, end, kind, entity in found:
        out += [text[at:start], in_format(text[start:end], kind, surrogate(kind, entity))]
        at = end
    return "".join([*out, text[at:]]), len(found)


def resolve(entities: DataFrame, secret: bytes, max_rounds: int = 60) -> DataFrame:
    """``(type, entity, attempt, surrogate)`` for the distinct rows of ``entities(type, entity)``.

    Of the entities of a type that propose the same surrogate the smallest keeps it; the others,
    and all whose proposal is an entity of the corpus, try again; given names and surnames count as
    one type here.  Where a format has fewer values than the corpus has entities of it, the rounds
    run out and a RuntimeError says so.  A check is one aggregation by
    surrogate over entities and proposals together, so a hot entity is one row.
    """

    @F.pandas_udf("string")
    def proposal(kinds: pd.Series, names: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([propose(secret, k, e, int(a)) for k, e, a in zip(kinds, names, attempts, strict=True)], dtype=object)

    def proposed(frame: DataFrame) -> DataFrame:
        return materialize(frame.withColumn("surrogate", proposal("type", "entity", "attempt")), "proposals")

    table = proposed(entities.select("type", "entity", F.lit(0).alias("attempt")))
    space = F.when(F.col("type").rlike("^(given|surname)"), "name").otherwise(F.col("type")).alias("space")
    claim = F.concat_ws("=", F.lit(""), "type", "entity").alias("claim")
    for _ in range(max_rounds):
        # An original counts as "" in the comparison, so it goes before every proposal.
        claims = table.select(space, "surrogate", claim).unionByName(
            table.select(space, F.col("entity").alias("surrogate"), F.lit("").alias("claim"))
        )
        crowded = claims.groupBy("space", "surrogate").agg(F.min("claim").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        checked = table.withColumn("space", space).withColumn("claim", claim).join(crowded, ["space", "surrogate"], "left")
        checked = checked.withColumn("lost", F.coalesce(F.col("first") != F.col("claim"), F.lit(False)))
        checked = materialize(checked.select("type", "entity", "attempt", "surrogate", "lost"), "checked")
        if not checked.filter("lost").limit(1).count():
            return checked.drop("lost")
        kept = checked.filter("NOT lost").select("type", "entity", "attempt", "surrogate")
        again = checked.filter("lost").select("type", "entity", (F.col("attempt") + 1).alias("attempt"))
        again = again.withColumn("surrogate", proposal("type", "entity", "attempt"))
        table = materialize(kept.unionByName(again), "proposals")
    raise RuntimeError(f"surrogates still clash after {max_rounds} rounds")


def pseudonymise(docs: DataFrame, secret: bytes, broadcast_rows: int = 50_000) -> DataFrame:
    """``docs`` with its ``text`` replaced and a column ``n_replaced``; other columns as they are.

    Null texts stay null and empty ones empty, with 0 replacements; rows are neither added nor lost,
    also if they are repeated or lack an id; whole texts are searched.  Equal texts stay equal.

    Whoever knows ``secret`` can test guesses of an original, so it has to be kept.  The generator's first proposals need no table in the tasks.  Entities that had to try again are
    broadcast if there are at most ``broadcast_rows`` of them, and joined to the texts they occur
    in otherwise.  A column that is called ``n_replaced`` already is replaced;
    names that start with two underscores are this function's own.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_replaced")

    @F.pandas_udf("array<struct<type:string,entity:string>>")
    def mentions(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({(k, e) for _, _, k, e in find_entities(t or "")}) for t in texts], dtype=object)

    seen = docs.select(F.xxhash64("text").alias("print"), F.explode(mentions("text")).alias("m"))
    seen = materialize(seen.select("print", "m.type", "m.entity").distinct(), "mentions")
    resolved = resolve(seen.select("type", "entity").distinct(), secret)
    moved = materialize(resolved.filter("attempt > 0"), "moved")
    kind = "text string, n_replaced long"

    def rewrite(text: str | None, attempts: dict) -> tuple[str | None, int]:
        if not text:
            return text, 0

        @lru_cache(maxsize=None)
        def surrogate(kind: str, entity: str) -> str:
            return propose(secret, kind, entity, attempts.get((kind, entity), 0))

        return replace_entities(text, surrogate)

    if moved.count() <= broadcast_rows:
        shared = spark.sparkContext.broadcast({(r["type"], r["entity"]): r["attempt"] for r in moved.collect()})

        @F.pandas_udf(kind)
        def by_table(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, shared.value) for t in texts], columns=["text", "n_replaced"])

        done = docs.withColumn("__new", by_table("text"))
    else:
        own = (
            seen.join(moved, ["type", "entity"])
            .groupBy("print")
            .agg(F.collect_list(F.struct("type", "entity", "attempt")).alias("__moved"))
        )

        @F.pandas_udf(kind)
        def by_row(texts: pd.Series, moves: pd.Series) -> pd.DataFrame:
            rows = [
                rewrite(t, {(x["type"], x["entity"]): x["attempt"] for x in ([] if m is None else m)})
                for t, m in zip(texts, moves, strict=True)
            ]
            return pd.DataFrame(rows, columns=["text", "n_replaced"])

        prints = docs.withColumn("__print", F.xxhash64("text"))
        done = prints.join(own.withColumnRenamed("print", "__print"), "__print", "left").drop("__print")
        done = done.withColumn("__new", by_row("text", "__moved")).drop("__moved")
    columns = [F.col("__new.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return done.select(*columns, F.col("__new.n_replaced").alias("n_replaced"))
