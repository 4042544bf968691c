"""Cell text -> events, as column expressions (no UDF)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values -------------------------------------------------------------------------------
REFERENCE = "WT"
EVENT_TYPES = ("MISSENSE", "SYNONYMOUS", "NONSENSE", "FRAMESHIFT", "SPLICE", "INFRAME_INDEL", "OTHER")
TRUNCATING = ("NONSENSE", "FRAMESHIFT", "SPLICE")
AMINO = "ACDEFGHIKLMNPQRSTVWY"
SUBSTITUTION = "^([A-Z*])(-?[0-9]+)([A-Z*])$"
SPLICE = "SPLICE|IVS|[+-][0-9]+"
INDEL = "DEL|INS|DUP"
ATOMIC = "(?i)(?:[A-Z*][0-9]+(?:[A-Z*]|FS(?:INS|DEL)?|FRAMESHIFT)|[0-9]+_[0-9]+[A-Z*]+>[A-Z*]+)"
POSITION_RANGES = ((1, 50), (51, 100), (101, 250), (251, 500), (501, 1000), (1001, None))
# --------------------------------------------------------------------------------------------

_BLANKS = " \t\n\r\f\x0b"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _empty() -> Column:
    return F.array().cast("array<string>")


def normalise_cell(cell: Column) -> Column:
    """Upper-cased events of a cell, first occurrence kept; null, blank and reference give none."""
    text = F.upper(_strip(cell))
    pieces = F.filter(F.split(F.regexp_replace(text, "[;,|]+", " "), "\\s+"), lambda x: x != "")
    events = F.array_distinct(F.transform(pieces, lambda x: F.regexp_replace(x, "^P\\.", "")))
    return F.when(text.isNull() | text.isin("", REFERENCE), _empty()).otherwise(events)


def split_whitespace(cell: Column, dedupe: bool = False) -> Column:
    """Case-sensitive split on blanks only."""
    text = _strip(cell)
    pieces = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    pieces = F.array_distinct(pieces) if dedupe else pieces
    return F.when(text.isNull() | text.isin("", REFERENCE), _empty()).otherwise(pieces)


def split_grammar(cell: Column) -> Column:
    """Split on ; | / , and unglue a segment that is nothing but two or more atomic events."""
    text = _strip(cell)
    segments = F.transform(F.split(text, "\\s*[;|/,]\\s*"), _strip)

    def pieces(segment: Column) -> Column:
        atoms = F.regexp_extract_all(segment, F.lit(ATOMIC), 0)
        rest = _strip(F.regexp_replace(segment, ATOMIC, ""))
        return F.when((F.size(atoms) >= 2) & (rest == ""), F.transform(atoms, _strip)).otherwise(F.array(segment))

    flat = F.filter(
        F.flatten(F.transform(segments, pieces)),
        lambda x: (x != "") & ~F.upper(x).isin(REFERENCE, "NAN"),
    )
    return F.when(text.isNull() | F.upper(text).isin("", REFERENCE, "NAN"), _empty()).otherwise(F.array_distinct(flat))


def single_event(cell: Column) -> Column:
    """The whole cell as one upper-cased event, null where the cell holds none."""
    text = _strip(cell)
    return F.when(text.isNotNull() & ~text.isin("", "WT", "wt", "NAN", "nan"), F.upper(text))


def is_reference(cell: Column) -> Column:
    text = F.upper(_strip(cell))
    return F.coalesce(text.isin("", REFERENCE), F.lit(False))


# Event classifiers ---------------------------------------------------------------------------
# Every dialect is an ordered list of (label, predicate); the first that holds wins.


def _first_match(rules, default: str) -> Column:
    out = None
    for label, predicate in rules:
        label = label if isinstance(label, Column) else F.lit(label)
        out = F.when(predicate, label) if out is None else out.when(predicate, label)
    return out.otherwise(F.lit(default))


def _same_ends(event: Column) -> Column:
    return F.substring(event, 1, 1) == F.substring(event, -1, 1)


def _standard7(e: Column, stop: Column) -> Column:
    return _first_match(
        [
            ("FRAMESHIFT", e.contains("FS")),
            ("SPLICE", e.rlike(SPLICE)),
            ("INFRAME_INDEL", e.rlike(INDEL)),
            ("NONSENSE", stop),
            ("SYNONYMOUS", e.rlike(SUBSTITUTION) & _same_ends(e)),
            ("MISSENSE", e.rlike(SUBSTITUTION)),
        ],
        "OTHER",
    )


def standard7(e: Column) -> Column:
    return _standard7(e, e.contains("*") | e.endswith("X"))


def standard7_strict_x(e: Column) -> Column:
    e = F.regexp_replace(F.upper(e), "^P\\.", "")
    return _standard7(e, e.contains("*") | e.rlike("^[A-Z*]-?[0-9]+X$"))


def compact6(e: Column) -> Column:
    shape = "(?s)^([A-Z*]+)([0-9]+)(.*)$"
    ref, alt = F.regexp_extract(e, shape, 1), F.regexp_extract(e, shape, 3)
    return _first_match(
        [
            ("other", e.contains(">")),
            ("frameshift", e.contains("fs")),
            ("indel", e.contains("del") | e.contains("ins")),
            ("other", ~e.rlike(shape)),
            ("other", (ref == "*") & (alt == "*")),
            ("nonsense", alt == "*"),
            ("silent", alt == ref),
            ("other", alt == ""),
        ],
        "missense",
    )


def basic5(e: Column) -> Column:
    change = e.rlike("^[A-Z*][0-9]+[A-Z*]$")
    return _first_match(
        [
            ("frameshift", F.lower(e).contains("fs")),
            ("nonsense", e.contains("*")),
            ("synonymous", change & _same_ends(e)),
            ("missense", change),
        ],
        "other",
    )


def detail9(e: Column) -> Column:
    return _first_match(
        [
            ("FRAMESHIFT", e.contains("FS")),
            ("DELINS", e.contains("DELINS")),
            ("INFRAME_INS", e.contains("INS")),
            ("INFRAME_DEL", e.contains("DEL")),
            ("SPLICE", e.contains("SPLICE")),
            ("NONSENSE", e.rlike("TER|[*]|X")),
            ("MISSENSE", e.rlike("^[A-Z*][0-9]+[A-Z*]$")),
        ],
        "OTHER",
    )


def detail8(e: Column) -> Column:
    return _first_match(
        [
            ("FRAMESHIFT", e.contains("FS")),
            ("INFRAME_INS", e.contains("INS")),
            ("INFRAME_DEL", e.contains("DEL")),
            ("SPLICE", e.contains("SPLICE")),
            ("NONSENSE", e.rlike("TER|[*]|X")),
            ("MISSENSE", e.rlike("^[A-Z*][0-9]+[A-Z*]$")),
        ],
        "OTHER",
    )


def canonical14(event: Column) -> Column:
    e = F.replace(F.upper(event), F.lit(" "), F.lit(""))
    lost = e.contains("LOSS") | e.contains("LOST")
    change = "^([A-Z*])([0-9]+)([A-Z*])$"
    return _first_match(
        [
            ("SPLICE", e.rlike(SPLICE)),
            ("START_LOSS", e.contains("START") & lost),
            ("STOP_LOSS", e.contains("STOP") & lost),
            ("FRAMESHIFT_INS", e.rlike("FS|FRAMESHIFT") & e.contains("INS")),
            ("FRAMESHIFT_DEL", e.rlike("FS|FRAMESHIFT")),
            ("DELINS_COMPLEX", e.rlike("DELINS|COMPLEX|^[0-9]+_[0-9]+[A-Z*]+>[A-Z*]+$")),
            ("DUPLICATION", e.contains("DUP")),
            ("INFRAME_INS", e.contains("INS")),
            ("INFRAME_DEL", e.contains("DEL")),
            ("NONSENSE", e.rlike(change) & e.endswith("*")),
            ("SYNONYMOUS", e.rlike(change) & _same_ends(e)),
            ("MISSENSE", e.rlike(change)),
            ("OTHER_VALID", e.rlike("^[A-Z*]?[0-9]+$")),
        ],
        "UNKNOWN",
    )


def legacy_type(kind: Column) -> Column:
    """Fold the fourteen canonical types down to the seven older ones."""
    return (
        F.when(kind.isin("FRAMESHIFT_INS", "FRAMESHIFT_DEL"), "FRAMESHIFT")
        .when(kind.isin("INFRAME_INS", "INFRAME_DEL", "DUPLICATION", "DELINS_COMPLEX"), "INFRAME_DEL")
        .when(kind.isin("STOP_LOSS", "START_LOSS"), "NONSENSE")
        .when(kind.isin("MISSENSE", "SYNONYMOUS", "NONSENSE", "SPLICE"), kind)
        .otherwise("OTHER")
    )


def state3(e: Column) -> Column:
    return _first_match(
        [("truncating", F.lower(e).rlike("fs|[*]|ter")), ("missense_like", e.rlike("^[A-Z][0-9]+[A-Z*]$"))], "other"
    )


def eda7(e: Column) -> Column:
    low = F.lower(e)
    return _first_match(
        [
            ("WT", e == REFERENCE),
            ("Frameshift", low.rlike("fs|frameshift")),
            ("Splice", low.rlike("splice")),
            ("Nonsense", low.rlike("[*]|stop|ter")),
            ("Indel", low.rlike("del|ins|dup")),
            ("Missense_like", low.rlike("p[.][a-z][0-9]+[a-z]|^[a-z][0-9]+[a-z]$")),
        ],
        "Other",
    )


DIALECTS = {
    "standard7": standard7,
    "standard7_strict_x": standard7_strict_x,
    "compact6": compact6,
    "basic5": basic5,
    "detail9": detail9,
    "detail8": detail8,
    "canonical14": canonical14,
    "state3": state3,
    "eda7": eda7,
}


# Parts of an event ---------------------------------------------------------------------------


def _group(event: Column, pattern: str, index: int) -> Column:
    got = F.regexp_extract(event, pattern, index)
    return F.when(got != "", got)


def substitution_ref(event: Column) -> Column:
    return _group(event, SUBSTITUTION, 1)


def substitution_position(event: Column) -> Column:
    return _group(event, SUBSTITUTION, 2).try_cast("bigint")


def substitution_alt(event: Column) -> Column:
    return _group(event, SUBSTITUTION, 3)


def first_integer(event: Column) -> Column:
    return _group(event, "([0-9]+)", 1).try_cast("bigint")


def leading_position(event: Column) -> Column:
    return _group(event, "^[A-Z*](-?[0-9]+)", 1).try_cast("bigint")


def position_range(position: Column) -> Column:
    """Index 0..5 of the six fixed ranges; null for a missing or non-positive position."""
    out = F.lit(None).cast("int")
    for index, (low, high) in reversed(list(enumerate(POSITION_RANGES))):
        hit = position >= low if high is None else position.between(low, high)
        out = F.when(hit, F.lit(index)).otherwise(out)
    return out


def position_bin(position: Column, origin: str = "one", width: int = 50) -> Column:
    """Fixed-width bins.  origin 'one' starts at 1, 'zero' at 0, 'label' gives 'start_end' clamped at 1."""
    if origin == "zero":
        return F.floor(position / width)
    if origin == "one":
        return F.floor((position - 1) / width)
    start = F.floor((F.greatest(position, F.lit(1)) - 1) / width) * width + 1
    return F.concat_ws("_", start.cast("string"), (start + (width - 1)).cast("string"))


def codon_key(gene: Column, event: Column) -> Column:
    """gene__refpos for point changes (missense or stop) of the compact dialect."""
    shape = "(?s)^([A-Z*]+)([0-9]+)(.*)$"
    return F.when(
        compact6(event).isin("missense", "nonsense"),
        F.concat(gene, F.lit("__"), F.regexp_extract(event, shape, 1), F.regexp_extract(event, shape, 2)),
    )


def amino_pair(ref: Column, alt: Column) -> Column:
    letters = list(AMINO)
    return F.when(ref.isin(letters) & alt.isin(letters) & (ref != alt), F.concat(ref, F.lit(">"), alt))


def event_sentence(gene: Column, event_type: Column, ref: Column, position: Column, alt: Column) -> Column:
    def some(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("NONE"))

    return F.format_string(
        "gene %s type %s ref %s position %s alt %s", gene, event_type, some(ref), some(position), some(alt)
    )


# Token builders: level -> token column over (gene, event, event_type, ref, position, alt) -----


def token(level: str) -> Column:
    gene, event, kind = F.col("gene"), F.col("event"), F.col("event_type")
    ref, alt = F.col("ref"), F.col("alt")
    lead = leading_position(event)

    def key(*parts) -> Column:
        # concat (unlike concat_ws) is null when a part is, so such an event yields no token
        out = []
        for part in parts:
            out += [F.lit("__"), part]
        return F.concat(*out[1:])

    if level == "gene":
        return gene
    if level == "exact":
        return key(gene, event)
    if level == "gene_type":
        return key(gene, kind)
    if level == "codon":
        return key(gene, F.concat(F.lit("POS"), first_integer(event).cast("string")))
    if level == "locus":
        return key(gene, F.concat(F.lit("P"), lead.cast("string")))
    if level == "gene_bin":
        return key(gene, F.concat(F.lit("BIN_"), F.when(lead.isNotNull(), position_bin(lead, "label"))))
    if level == "signature":
        return key(gene, kind, F.concat(F.lit("BIN_"), F.when(lead.isNotNull(), position_bin(lead, "label"))))
    if level == "signature_zero":
        return key(gene, kind, F.concat(F.lit("b"), position_bin(first_integer(event), "zero").cast("string")))
    if level == "substitution":
        return key(gene, amino_pair(ref, alt))
    if level == "type":
        return F.concat(F.lit("TYPE__"), kind)
    raise ValueError(f"unknown token level {level}")


TOKEN_LEVELS = (
    "gene", "exact", "gene_type", "codon", "locus", "gene_bin", "signature", "signature_zero", "substitution", "type",
)
