"""Surrogates for personal data.

Entities are found by patterns and replaced by keyed surrogates of the same type and format:
a digit becomes a digit, a capital a capital, an address a valid address, a name a made-up name
of the same script and gender. The replacement is a keyed Feistel permutation of the entity's
variable part, so different entities of one format stay different and the same entity gets the
same surrogate everywhere. What a permutation cannot promise, that a surrogate is not another
entity's real value and that names built from syllables differ, is checked over all distinct
entities; those that clash are drawn again with the next attempt number until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.text import fresh, let
from riskline.session import materialize

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Sr", "Señor", "Monsieur", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Sra", "Señora", "Mme", "Madame", "г-жа", "госпожа"),
    "n": ("Dr", "Prof"),
}
_TITLE = "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
_SECRET_NAME = r"(?=[AaPpTtSs])(?i:api[_-]?key|access[_-]?key|password|passwd|pwd|token|secret)(?:[_-][A-Za-z0-9]{1,32}){0,4}(?:\\?[\"'])?\s{0,3}[=:]"
# A part of a name: a word, after initials or not.
_INITIAL = r"(?:\p{Lu}\.){1,3}|\p{Lu}"
_NAME = rf"(?:(?:{_INITIAL}) ){{0,3}}\p{{Lu}}[\p{{L}}'-]+"
#: type -> (pattern, pattern of the leading part that stays). The order is the order of preference.
TYPES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", r"^"),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", r"^-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "secret": (rf"(?<![A-Za-z0-9]){_SECRET_NAME}\s{{0,3}}(?:\"[^\"\r\n]{{1,256}}(?=\")|'[^'\r\n]{{1,256}}(?=')|(?:\\?[\"'])?[^\s\"']{{4,}})", rf"^{_SECRET_NAME}\s*(?:\\?[\"'])?"),
    "access_key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp|gho|ghs|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}", r"^(?:AKIA|ASIA|[a-z]+[_-])"),
    "web_token": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"^eyJ"),
    "ipv4": (rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])", r"^"),
    "mac": (r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", r"^"),
    "ipv6": (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])2[0-9A-Fa-f]{3}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?(?![0-9A-Za-z:])", r"^"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^"),
    "phone": (r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])", r"^(?:\+[0-9]{1,3}(?=[ .(-]))?"),
    "card": (r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])", r"^"),
    "name": (rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}", rf"^(?:{_TITLE})\.? "),
}
PATTERN = "|".join(f"(?:{p})" for p, _ in TYPES.values())
# A text without any of these holds no entity, and is spared the patterns.
GATE = rf"[0-9@]|eyJ|-----BEGIN|{_SECRET_NAME}|(?:{_TITLE})\.? \p{{Lu}}"
ROUNDS = 4
ATTEMPTS = 24
# Later attempts add digits, so that a format with few values does not run out of them.
LONGER = 8
DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Letters of other scripts that move inside their class.
LETTERS = (
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґђјљњћџ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯІЇЄҐЂЈЉЊЋЏ",
    "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßāăąćčďđēęěğīłńňőœřśşšťūůűźżž", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞĀĂĄĆČĎĐĒĘĚĞĪŁŃŇŐŒŘŚŞŠŤŪŮŰŹŻŽ",
)
# Sign classes of a value: any, lower or upper hexadecimal, signs only.
ANY, HEX_LOWER, HEX_UPPER, SIGNS = range(4)
# Syllables and gendered endings by script, for names that no list of real names limits.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge go ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi wa".split(), {"m": ("n", "r", "s", "ld"), "f": ("a", "ia", "ina", "ela"), "n": ("n", "l", "r", "t")}),
    "cyrillic": ("ба бе бо ва ве ви га го да де ди до за ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си та те ти то".split(), {"m": ("н", "р", "в", "й"), "f": ("а", "ия", "на", "ва"), "n": ("н", "р", "к", "т")}),
}


def _number(*parts: Column) -> Column:
    """60 bits of a keyed digest of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def _shift(half: Column, other: Column, key: Column, tweak: Column, hexes: Column) -> Column:
    """``half`` with every letter and digit moved inside its class by a stream keyed by ``other``.

    Letters and digits of no class become one of a-z, as all signs do where there is nothing else.
    """

    def moved(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = F.conv(F.substring(stream, (2 * (i % 64) + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + (i / 64).cast("int")
            within = lambda letters: F.substring(
                F.lit(letters), ((F.instr(F.lit(letters), c) - 1 + n) % len(letters) + 1).cast("int"), F.lit(1)
            )
            letters = F.lit(LOWERS)
            for script in LETTERS:
                letters = F.when(F.instr(F.lit(script), c) > 0, F.lit(script)).otherwise(letters)
            beyond = lambda found: F.substring(found, (F.pmod(F.instr(found, c) - 1 + n, F.length(found)) + 1).cast("int"), F.lit(1))
            return (
                F.when((hexes == HEX_LOWER) & c.rlike("[0-9a-f]"), within("0123456789abcdef"))
                .when((hexes == HEX_UPPER) & c.rlike("[0-9A-F]"), within("0123456789ABCDEF"))
                .when(c.rlike("[0-9]"), within(DIGITS))
                .when(c.rlike("[a-z]"), within(LOWERS))
                .when(c.rlike("[A-Z]"), within(UPPERS))
                .when((hexes == SIGNS) | (c > "\x7f") & c.rlike(r"[\p{L}\p{N}]"), let(letters, beyond))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), one), "")

    return F.when(F.length(half) == 0, half).otherwise(let(F.sha2(F.concat_ws("\x1f", key, tweak, other), 512), moved))


def _permuted(value: Column, key: Column, tweak: Column, signs: Column) -> Column:
    """A permutation of all strings with the shape of ``value``, chosen by key and tweak.

    Where ``signs`` holds, a value without letters and digits becomes letters.
    """
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    both = bare.rlike("[A-Fa-f]") & bare.rlike("[0-9]")
    hexes = (
        F.when(both & bare.rlike("^[0-9a-f]+$"), HEX_LOWER)
        .when(both & bare.rlike("^[0-9A-F]+$"), HEX_UPPER)
        .when(signs & ~value.rlike(r"[\p{L}\p{N}]"), SIGNS)
        .otherwise(ANY)
    )
    cut = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
    for i in range(ROUNDS):
        t = F.concat_ws("\x1f", tweak, F.lit(str(i)))
        if i % 2 == 0:
            halves = let(halves, lambda h, t=t: F.struct(h["l"].alias("l"), _shift(h["r"], h["l"], key, t, hexes).alias("r")))
        else:
            halves = let(halves, lambda h, t=t: F.struct(_shift(h["l"], h["r"], key, t, hexes).alias("l"), h["r"].alias("r")))
    return let(halves, lambda h: F.concat(h["l"], h["r"]))


def _address(value: Column, key: Column, tweak: Column) -> Column:
    """A permutation of the 32-bit addresses: a Feistel network on 16-bit halves."""
    part = lambda x, i: F.split(x, r"\.")[i].cast("long")
    state = F.struct((part(value, 0) * 256 + part(value, 1)).alias("l"), (part(value, 2) * 256 + part(value, 3)).alias("r"))
    for i in range(ROUNDS):
        state = let(
            state,
            lambda h, i=i: F.struct(
                h["r"].alias("l"),
                h["l"].bitwiseXOR(_number(key, tweak, F.lit(str(i)), h["r"].cast("string")) % 65536).alias("r"),
            ),
        )
    return let(state, lambda h: F.concat_ws(".", *[F.floor(x / 256).cast("string") if hi else (x % 256).cast("string") for x in (h["l"], h["r"]) for hi in (1, 0)]))


def _luhn(digits: Column) -> Column:
    """The check digit that card numbers put behind ``digits``."""

    def doubled(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 1, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    each = F.transform(F.split(F.reverse(digits), ""), doubled)
    return (10 - F.aggregate(each, F.lit(0), lambda a, n: a + n) % 10) % 10


def _mod97(bban: Column, country: Column) -> Column:
    """The two check digits of an account number, as a number from 2 to 98."""

    def step(a: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(n > 9, 100).otherwise(10) + n) % 97

    signs = F.split(F.concat(F.regexp_replace(bban, " ", ""), country, F.lit("00")), "")
    return 98 - F.aggregate(signs, F.lit(0), step)


def _made_up(value: Column, key: Column, attempt: Column, gender: Column) -> Column:
    """A name of syllables of the same script, capitalised, with the gender's ending."""

    def built(digest: Column) -> Column:
        part = lambda k: F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int")
        result = None
        for script, (parts, endings) in reversed(list(SYLLABLES.items())):
            table = F.array(*map(F.lit, parts))
            pick = lambda k, table=table, size=len(parts): F.element_at(table, part(k) % size + 1)
            body = F.concat(pick(0), pick(1), pick(2))
            end = F.lit(None).cast("string")
            for g, choice in endings.items():
                ends = F.array(*map(F.lit, choice))
                end = F.when(gender == g, F.element_at(ends, part(3) % len(choice) + 1)).otherwise(end)
            extra = F.when(attempt > 0, pick(4)).otherwise(F.lit(""))
            more = F.when(attempt > 3, F.concat(pick(5), pick(6))).otherwise(F.lit(""))
            name = F.initcap(F.concat(body, extra, more, end))
            result = name if result is None else F.when(value.rlike(r"\p{IsCyrillic}"), result).otherwise(name)
        return result

    seed = F.concat_ws("\x1f", key, F.lit("name"), attempt.cast("string"), F.lower(value))
    return let(F.sha2(seed, 256), built)


def _moved_initials(unit: Column, key: Column) -> Column:
    """Initials, every letter moved by a keyed number of places that is never none."""

    def one(c: Column) -> Column:
        n = _number(key, F.lit("initial")) % 25 + 1
        other = F.lit(UPPERS)
        for script in LETTERS[1::2]:
            other = F.when(F.instr(F.lit(script), c) > 0, F.lit(script)).otherwise(other)
        return F.when(c == ".", c).otherwise(let(other, lambda s: F.substring(s, (F.pmod(F.instr(s, c) - 1 + n, F.length(s)) + 1).cast("int"), F.lit(1))))

    return F.array_join(F.transform(F.split(unit, ""), one), "")


def _initials(unit: Column) -> Column:
    return unit.rlike(rf"^(?:{_INITIAL})$")


def _typed(found: Column) -> Column:
    """Struct of type, the leading part that stays, and the units to replace."""
    kind = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(TYPES.items()):
        kind = F.when(found.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    # A context at the edge of a match may not show any more; such a match is a secret.
    kind = F.coalesce(kind, F.lit("secret"))

    def split(k: Column) -> Column:
        lead = F.lit("")
        for name, (_, stays) in reversed(TYPES.items()):
            lead = F.when(k == name, F.regexp_extract(found, stays, 0)).otherwise(lead)
        gender = F.lit("n")
        for g, titles in TITLES.items():
            gender = F.when(found.rlike(rf"^(?:{'|'.join(titles)})\.? "), F.lit(g)).otherwise(gender)
        return let(
            lead,
            lambda x: F.struct(
                k.alias("type"),
                x.alias("lead"),
                # The last part, a surname, has no gender: it is one name after all titles.
                let(
                    F.when(k == "email", F.array(F.lower(found)))
                    .when(k == "name", F.split(F.substring(found, F.length(x) + 1, F.length(found)), " ")).otherwise(
                        F.array(F.substring(found, F.length(x) + 1, F.length(found)))
                    ),
                    lambda parts: F.transform(
                        parts,
                        lambda u, i: F.struct(u.alias("unit"), F.when((k == "name") & (i < F.size(parts) - 1) & ~_initials(u), gender).otherwise(F.lit("n")).alias("gender")),
                    ),
                ).alias("units"),
            ),
        )

    return let(kind, split)


def surrogate(kind: Column, unit: Column, gender: Column, attempt: Column, key: Column) -> Column:
    """The replacement of one unit: of a name part, or of what follows the leading part.

    Mail addresses keep their last domain, cards their first digit and accounts their country, and
    the check digits of these two are as far from right ones as they were.
    """
    tweak = F.concat_ws("\x1f", kind, attempt.cast("string"))
    domain = F.substring_index(unit, ".", -1)
    head = F.when(kind == "card", F.substring(unit, 1, 1)).when(kind == "iban", F.substring(unit, 1, 4)).otherwise(F.lit(""))
    tail = F.when(kind == "card", F.substring(unit, -1, 1)).when(kind == "email", domain).otherwise(F.lit(""))
    inner = let(
        F.struct(head.alias("h"), tail.alias("t")),
        lambda x: F.substring(unit, F.length(x["h"]) + 1, F.length(unit) - F.length(x["h"]) - F.length(x["t"])),
    )
    bare = lambda x: F.regexp_replace(x, "[^0-9]", "")
    country = F.substring(unit, 1, 2)

    def built(x: Column) -> Column:
        old, new = x["old"], x["new"]
        stem = lambda v: bare(F.concat(head, v))
        last = F.pmod(_luhn(stem(new)) + tail.cast("int") - _luhn(stem(old)), F.lit(10)).cast("string")
        off = F.substring(unit, 3, 2).cast("int") - _mod97(old, country)
        check = F.lpad((F.pmod(_mod97(new, country) - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0")
        mark = F.when(attempt > 0, F.substring(F.sha2(F.concat_ws("\x1f", key, tweak, unit), 256), 1, 6)).otherwise(F.lit(""))
        more = F.when(attempt > LONGER, F.lpad((_number(key, tweak, unit) % 1_000_000).cast("string"), 6, "0")).otherwise(F.lit(""))
        return (
            F.when(kind == "email", F.concat(mark, new, domain))
            .when(kind == "card", F.concat(head, new, last))
            .when(kind == "iban", F.concat(country, check, new))
            .otherwise(F.concat(new, more))
        )

    moved = let(inner, lambda v: let(F.struct(v.alias("old"), _permuted(v, key, tweak, kind == "secret").alias("new")), built))
    return (
        F.when((kind == "name") & _initials(unit), _moved_initials(unit, key))
        .when(kind == "name", _made_up(unit, key, attempt, gender))
        .when(kind == "ipv4", _address(unit, key, tweak))
        .otherwise(moved)
    )


def entities(text: Column) -> Column:
    """Array of the entities of a text in order, each typed and split."""
    none = F.array().cast("array<string>")
    matches = F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    return F.transform(matches, _typed)


def clashes(units: DataFrame, key: Column) -> DataFrame:
    """``type, unit, attempt`` of the units whose first surrogate will not do.

    ``units``: distinct type, unit, gender. A surrogate fails if it is a real unit of its type, or
    if it belongs to an earlier unit: one that keeps a lower attempt, or comes first by hash.
    Only failures are drawn again. The first round is a pass over all distinct units; a name
    unit seen with two genders counts as two.
    """
    drawn = units.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        drawn = materialize(drawn.withColumn("surrogate", surrogate(F.col("type"), F.col("unit"), F.col("gender"), F.col("attempt"), key)), "pii-drawn")
        real = units.select("type", F.col("unit").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        order = Window.partitionBy("type", "surrogate").orderBy("attempt", F.xxhash64("unit", "gender"), "unit", "gender")
        judged = drawn.join(real, ["type", "surrogate"], "left").withColumn("n", F.row_number().over(order))
        bad = F.col("real").isNotNull() | (F.col("n") > 1)
        # Other types than secrets have letters or digits to move; what has none is left.
        bad &= (F.col("type") == "secret") & (F.length("unit") > 0) | F.col("unit").rlike(r"[\p{L}0-9]")
        judged = materialize(judged.select("type", "unit", "gender", "attempt", bad.alias("bad")), "pii-judged")
        if judged.where("bad").isEmpty():
            break
        drawn = judged.select("type", "unit", "gender", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    else:
        raise RuntimeError(f"{judged.where('bad').count()} entities still have no surrogate of their own after {ATTEMPTS} attempts")
    return judged.where("attempt > 0").select("type", "unit", "gender", "attempt")


def replace(docs: DataFrame, key: str, text: str = "text", report: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; all other columns stay as they are.

    ``report`` names a column added with the array of entity types in order. A null text stays
    null, a text without entities stays as it is to the byte. Repeated rows get the same
    result, an empty table an empty one, and columns are free to have any name but ``report``.
    ``key`` decides all surrogates; without it they cannot be traced back. Parts of a name found after a
    title are replaced wherever else they stand as words in their text, by the first one's surrogate if titles of
    two genders precede a first name. Mail addresses count without case and become lower case. Distinct entities are
    counted with map-side aggregation; documents move only if some entity clashes, and then only
    their override lists are joined, by the hash of the text.
    """
    if report is not None and report in docs.columns:
        raise ValueError(f"{report} is a column already")
    secret = F.lit(key)
    spark = docs.sparkSession
    each = docs.select(F.explode(entities(F.col(text))).alias("e")).select(
        F.col("e.type").alias("type"), F.explode("e.units").alias("u")
    ).select("type", "u.gender", "u.unit")
    # Initials are too few to be told apart; each moves to another letter, the same everywhere.
    units = materialize(each.where(~((F.col("type") == "name") & _initials(F.col("unit")))).distinct(), "pii-units")
    again = materialize(clashes(units, secret), "pii-again") if not units.isEmpty() else spark.createDataFrame([], "type string, unit string, gender string, attempt int")
    found, over = fresh(docs, "found"), fresh(docs, "over")
    marked = docs.withColumn(found, entities(F.col(text)))
    overrides = F.lit(None).cast("map<string,int>")
    if not again.isEmpty():
        at = fresh(docs, "hash")
        named = docs.select(F.xxhash64(text).alias(at), F.explode(entities(F.col(text))).alias("e")).select(
            at, F.col("e.type").alias("type"), F.explode("e.units").alias("u")
        ).select(at, "type", "u.gender", "u.unit").distinct()
        lists = named.join(again, ["type", "gender", "unit"]).groupBy(at).agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "type", "gender", "unit"), "attempt"))).alias(over)
        )
        marked = marked.withColumn(at, F.xxhash64(text)).join(materialize(lists, "pii-over"), at, "left").drop(at)
        overrides = F.col(over)

    def replaced(e: Column) -> Column:
        def unit(u: Column) -> Column:
            attempt = F.coalesce(F.element_at(overrides, F.concat_ws("\x1f", e["type"], u["gender"], u["unit"])), F.lit(0))
            return surrogate(e["type"], u["unit"], u["gender"], attempt, secret)

        return F.concat(e["lead"], F.array_join(F.transform(e["units"], unit), " "))

    def named(e: Column) -> Column:
        """Parts of names with their surrogates."""

        def pair(u: Column) -> Column:
            attempt = F.coalesce(F.element_at(overrides, F.concat_ws("\x1f", e["type"], u["gender"], u["unit"])), F.lit(0))
            return F.struct(u["unit"].alias("unit"), _made_up(u["unit"], secret, attempt, u["gender"]).alias("made"))

        return F.transform(F.filter(e["units"], lambda u: ~_initials(u["unit"])), pair)

    def without_names(pieces: Column, names: Column) -> Column:
        """The text between entities, where the parts of its names stand without a title.

        No surrogate is a real part of a name, so a replaced one is not replaced again.
        """
        once = lambda piece: F.aggregate(
            names, piece,
            lambda a, n: F.when(F.contains(a, n["unit"]), F.regexp_replace(a, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), n["unit"], F.lit(r"\E(?![\p{L}\p{N}_])")), n["made"])).otherwise(a),
        )
        return F.when(F.size(names) > 0, F.transform(pieces, once)).otherwise(pieces)

    names = F.flatten(F.transform(F.filter(F.col(found), lambda e: e["type"] == "name"), named))
    pieces = let(names, lambda n: without_names(F.split(F.col(text), PATTERN, -1), n))
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.transform(F.col(found), replaced), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    out = marked.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(F.col(text)))
    if report is not None:
        out = out.withColumn(report, F.transform(found, lambda e: e["type"]))
    return out.select(*[f"`{c}`" for c in docs.columns], *([report] if report else []))


KEY_SETTING = "spark.riskline.pii.key"
# For data that is not private, as test tables.
KEY = "corpus-surrogates-1"


def session_key(spark) -> str:
    """The key that the session's settings name; private data need one."""
    return spark.conf.get(KEY_SETTING, KEY)


def op10_pii_surrogates(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = replace(docs, session_key(spark), report="types")
    return out.select(
        "doc_id", "text", F.size("types").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("types")), ",").alias("types"),
    )
