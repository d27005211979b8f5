"""License scans: ordered signature rules behind a keyword filter.

A rule is a regular expression over the words of a text, with a label, a keyword that any match
contains, and a priority. Only rules whose keyword occurs are tried. Detections become
intervals of word positions, and one that lies inside another of the same or a higher priority is
suppressed, so "general public license version 2" does not also count as the plain name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.text import let, whole

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases every scan looks for and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
GENERIC, NAMED, VERSIONED, TAGGED = range(4)


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int


def _spelled(version: str) -> str:
    """A version as words: ``2.0`` is ``2 0`` and, where the zero is dropped, ``2``."""
    major, _, minor = version.partition(".")
    return rf"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}" if minor else major


# Family, keyword, names as they are written in words, and versions.
FAMILIES = (
    ("gpl", "general public license", (r"(?:gnu )?general public license",), ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", (r"(?:gnu )?gpl",), ("1.0", "2.0", "3.0")),
    ("lgpl", "general public license", (r"(?:gnu )?(?:lesser|library) general public license",), ("2.0", "2.1", "3.0")),
    ("lgpl", "lgpl", (r"(?:gnu )?lgpl",), ("2.0", "2.1", "3.0")),
    ("agpl", "general public license", (r"(?:gnu )?affero general public license",), ("1.0", "3.0")),
    ("agpl", "agpl", (r"(?:gnu )?agpl",), ("1.0", "3.0")),
    ("gfdl", "free documentation license", (r"(?:gnu )?free documentation license",), ("1.1", "1.2", "1.3")),
    ("apache", "apache", (r"apache(?: software)? license", r"apache(?: org)? licenses license"), ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla public license", (r"mozilla public license",), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public license", (r"eclipse public license",), ("1.0", "2.0")),
    ("cpl", "common public license", (r"common public license",), ("1.0",)),
    ("cddl", "common development and distribution license", (r"common development and distribution license",), ("1.0", "1.1")),
    ("eupl", "european union public licence", (r"european union public licence",), ("1.0", "1.1", "1.2")),
    ("artistic", "artistic license", (r"artistic license",), ("1.0", "2.0")),
    ("bsl", "boost software license", (r"boost software license",), ("1.0",)),
    ("osl", "open software license", (r"open software license",), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free license", (r"academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("ofl", "open font license", (r"(?:sil )?open font license",), ("1.0", "1.1")),
    ("odbl", "open database license", (r"(?:odc )?open database license",), ("1.0",)),
    ("odc-by", "open data commons attribution license", (r"open data commons attribution license",), ("1.0",)),
    ("pddl", "public domain dedication and license", (r"public domain dedication and license",), ("1.0",)),
    ("zpl", "zope public license", (r"zope public license",), ("1.1", "2.0", "2.1")),
    ("lppl", "latex project public license", (r"latex project public license",), ("1.0", "1.1", "1.2", "1.3")),
    ("upl", "universal permissive license", (r"universal permissive license",), ("1.0",)),
    ("cecill", "cecill", (r"cecill(?: free software)?(?: license)?",), ("1.0", "1.1", "2.0", "2.1")),
    ("sspl", "server side public license", (r"server side public license",), ("1",)),
    ("busl", "business source license", (r"business source license",), ("1.1",)),
    ("ms-pl", "microsoft public license", (r"microsoft public license",), ()),
    ("ms-rl", "microsoft reciprocal license", (r"microsoft reciprocal license",), ()),
)
# Single signatures: label, keyword, pattern.
TEXTS = (
    ("mit", "mit license", r"mit license"),
    ("mit", "obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "isc license", r"isc license"),
    ("isc", "purpose with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms"),
    ("bsd", "bsd license", r"bsd license"),
    ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "public domain", r"(?:in|to|into) the public domain"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2(?: 0)?"),
)


def _creative_commons() -> list[Signature]:
    words = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    found = []
    for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        short = " ".join(parts.split("-"))
        spelled = " ".join(words[p] for p in parts.split("-"))
        forms = ((f"cc {short}", f"cc {short}"), ("creative commons", f"creative commons {spelled}"), ("creativecommons", f"creativecommons org licenses {short}"))
        for keyword, form in forms:
            found.append(Signature(f"cc-{parts}", keyword, form, NAMED))
            for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
                found.append(Signature(f"cc-{parts}-{version}", keyword, rf"{form}(?: international| unported)? {_spelled(version)}", VERSIONED))
    return found


def signatures() -> tuple[Signature, ...]:
    """All rules: families by version, texts, Creative Commons, and a tag for every label."""
    found = [Signature(label, keyword, pattern, NAMED) for label, keyword, pattern in TEXTS]
    for family, keyword, names, versions in FAMILIES:
        for name in names:
            found.append(Signature(family, keyword, name, NAMED))
            for v in versions:
                exact = rf"{name}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{_spelled(v)}"
                found.append(Signature(f"{family}-{v}", keyword, exact, VERSIONED))
                if family.endswith("gpl"):
                    found.append(Signature(f"{family}-{v}-or-later", keyword, exact + r"(?: of the license)? or (?:any |at your option any )?later(?: version)?", VERSIONED))
    for clauses in ("0", "1", "2", "3", "4"):
        found.append(Signature(f"bsd-{clauses}-clause", "bsd", rf"bsd {clauses} clause|{clauses} clause bsd", VERSIONED))
    found += _creative_commons()
    labels = dict.fromkeys(s.label for s in found)
    for label in labels:
        words = " ".join(label.replace(".", " ").replace("-", " ").split())
        found.append(Signature(label, "spdx license identifier", f"spdx license identifier {words}", TAGGED))
    found.append(Signature("reserved", "rights reserved", r"(?:all|some|no) rights reserved", GENERIC))
    found.append(Signature("copyright", "copyright", r"copyright(?: c)? \d{4}", GENERIC))
    return tuple(found)


SIGNATURES = signatures()


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spaced(text: Column) -> Column:
    """The words of a text, each between single spaces; one space for a text without words.

    ``lower`` also maps letters outside A-Z, but those stay outside ASCII or are the Kelvin
    sign, so neither the words' number nor any signature changes by it.
    """
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), F.lit(" "))))


def _hits(norm: Column, pattern: Column) -> Column:
    """Array of (first, last) word of each match of a pattern."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit("\x01$0\x02"))

    def positions(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: F.struct(x.alias("x"), (i - 1).alias("i")))
        first = F.transform(F.filter(numbered, lambda e: F.startswith(e["x"], F.lit("\x01"))), lambda e: e["i"])
        last = F.transform(F.filter(numbered, lambda e: F.endswith(e["x"], F.lit("\x02"))), lambda e: e["i"])
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return let(F.split(marked, " ", -1), positions)


def _resolve(found: Column) -> Column:
    """Labels of the detections that no other of the same or a higher priority contains.

    In order of first word, longest and highest first, a detection is contained exactly if an
    earlier one of its priority or above reaches as far, so one pass with the furthest end of
    each priority decides.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["first"], (-d["last"]).alias("o"), (-d["priority"]).alias("p"), d["label"])))
    start = F.struct(F.array(*[F.lit(-1)] * 4).alias("ends"), F.array().cast("array<struct<label:string,priority:int>>").alias("kept"))

    def step(state: Column, d: Column) -> Column:
        level, end = -d["p"], -d["o"]
        inside = F.array_max(F.slice(state["ends"], level + 1, F.lit(4))) >= end
        ends = F.transform(state["ends"], lambda x, i: F.when(i == level, F.greatest(x, end)).otherwise(x))
        new = F.array(F.struct(d["label"].alias("label"), level.alias("priority")))
        return F.struct(ends.alias("ends"), F.when(inside, state["kept"]).otherwise(F.array_union(state["kept"], new)).alias("kept"))

    return F.aggregate(order, start, step, lambda s: s["kept"])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """``keep``, n_words, base (intervals of the base phrases), found (labels with priority).

    One row per row of ``docs``; a null or empty text has no words and no detection. Repeated
    rows and null ids stay as they are, an empty table gives an empty result, and other columns
    are not looked at. All in the scan of the documents: no shuffle, no UDF. The rule table is a
    constant of the plan.
    """
    keywords = F.array(*[F.lit(k) for k in dict.fromkeys(r.keyword for r in rules)])
    table = F.array(*[
        F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"))
        for r in rules
    ])
    detection = "array<struct<first:int,last:int,priority:int,label:string>>"

    def detect(norm: Column) -> Column:
        def tried(present: Column) -> Column:
            each = F.transform(
                F.filter(table, lambda r: F.array_contains(present, r["keyword"])),
                lambda r: F.when(
                    F.rlike(norm, F.concat(F.lit("(?<= )(?:"), r["pattern"], F.lit(")(?= )"))),
                    F.transform(_hits(norm, r["pattern"]), lambda h: F.struct(h["first"], h["last"], r["priority"], r["label"])),
                ).otherwise(F.array().cast(detection)),
            )
            return _resolve(F.flatten(each).cast(detection))

        return let(F.filter(keywords, lambda k: F.contains(norm, k)), tried)

    phrases = "|".join(BASE)
    some_base = F.lit(False)
    for phrase in BASE:
        some_base |= F.contains(F.col("__norm"), F.lit(f" {phrase} "))
    some_rule = F.lit(False)
    for keyword in dict.fromkeys(r.keyword for r in rules):
        some_rule |= F.contains(F.col("__norm"), F.lit(keyword))
    norm = F.col("__norm")
    n_words = F.when(norm == " ", F.lit(0)).otherwise(_spaces(norm) - 1)
    return docs.select(*keep, spaced(whole(text)).alias("__norm")).select(
        *keep,
        n_words.cast("long").alias("n_words"),
        F.when(some_base, _hits(norm, F.lit(phrases))).otherwise(F.array().cast("array<struct<first:int,last:int>>")).alias("base"),
        *[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)).alias(f"__b{i}") for i, (p, label) in enumerate(BASE.items())],
        F.when(some_rule, let(norm, detect)).otherwise(F.array().cast("array<struct<label:string,priority:int>>")).alias("found"),
    ).select(
        *keep, "n_words", "base", F.array_compact(F.array(*[f"__b{i}" for i in range(len(BASE))])).alias("base_labels"), "found"
    )


def op3_license_scan(spark, folder: str) -> DataFrame:
    scanned = scan(spark.read.parquet(f"{folder}/documents.parquet"))
    firsts = F.transform("base", lambda b: b["first"])
    everything = F.array_union("base_labels", F.transform("found", lambda f: f["label"]))
    # A score for the best evidence: tag 1, version 0.75, name or base phrase 0.5, generic 0.25.
    best = F.array_max(F.array_union(F.transform("found", lambda f: f["priority"]), F.transform("base_labels", lambda _: F.lit(NAMED))))
    return scanned.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"),
        F.array_max(firsts).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(everything), ",").alias("labels"),
        F.coalesce((best + 1) / F.lit(4.0), F.lit(0.0)).alias("score"),
    )
