"""Column functions over sequences, count vectors and ids. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes of base sets.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M",
    "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N",
}


def reverse_complement(seq: Column, compat: bool = False) -> Column:
    """Reversed complement. compat: the variant under which G and C both become C."""
    return F.reverse(F.translate(seq, "ACGT", "TCCA" if compat else "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int | Column) -> Column:
    """All length-k substrings in order; empty for shorter sequences and null.

    One regular expression finds them in a single pass; a place in a string
    costs as much as it is far in, so taking them one by one would not.
    """
    k = F.lit(str(k)) if isinstance(k, int) else k.cast("string")
    pattern = F.concat(F.lit("(?s)(?=(.{"), k, F.lit("}))."))
    return F.coalesce(F.regexp_extract_all(seq, pattern, F.lit(1)), F.array().cast("array<string>"))


#: Letters in a number: up to so many as decimal digits, then as two bits each.
DECIMAL, BITS = 18, 31


def kmer_digits(seq: Column, k: int, both_strands: bool = False) -> Column:
    """All length-k substrings of A, C, G and T, in order, as digits 1 to 4, which sort as the letters do.

    One regular expression finds them in a single pass; substrings with any
    other letter are left out. both_strands: each as the smaller of itself and
    its reverse complement.
    """
    found = F.regexp_extract_all(F.translate(seq, "ACGT", "1234"), F.lit(f"(?=([1-4]{{{k}}}))"), F.lit(1))
    if both_strands:
        found = F.transform(found, lambda d: F.least(d, F.reverse(F.translate(d, "1234", "4321"))))
    return found


def pack(digits: Column, k: int) -> Column:
    if k <= DECIMAL:
        return digits.cast("bigint")
    return F.conv(F.translate(digits, "1234", "0123"), 4, 10).cast("bigint") if k <= BITS else digits


def unpack(code: Column, k: int) -> Column:
    """The letters of a code."""
    if DECIMAL < k <= BITS:
        return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return F.translate(code.cast("string"), "1234", "ACGT")


def window_min(values: Column, k: int) -> Column:
    """Minimum of every length-k window of an array; empty if it is shorter."""
    at = F.sequence(F.lit(1), F.size(values) - F.lit(k - 1))
    return F.when(F.size(values) >= k, F.transform(at, lambda i: F.array_min(F.slice(values, i, F.lit(k))))).otherwise(F.slice(values, 1, 0))


def overlap_join(parts: Column, k: int) -> Column:
    """Spell a path: the first sequence, then each next one without its first k-1 letters."""
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.substring(s, F.lit(k), F.length(s)))
    return F.concat(parts[0], F.array_join(tail, ""))


def half_even(x: Column) -> Column:
    """Round half to even."""
    return F.rint(x)


def clamp_difference(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def fraction(used: Column, whole: Column, pseudo: float = 0.01) -> Column:
    """used / whole + pseudo; 0 for 0/0; infinite for x/0."""
    return F.when((whole == 0) & (used == 0), 0.0).when(whole == 0, float("inf")).otherwise(F.try_divide(used, whole) + pseudo)


def counts_to_text(counts: Column) -> Column:
    return F.array_join(F.transform(counts, lambda c: c.cast("string")), ",")


def counts_from_text(text: Column) -> Column:
    return F.split(text, ",").cast("array<int>")


def encode_id(vid: Column) -> Column:
    """Sign and magnitude of a signed vertex id, as ``+:7``."""
    return F.concat(F.when(vid < 0, "-").otherwise("+"), F.lit(":"), F.abs(vid).cast("string"))


def decode_id(text: Column) -> Column:
    return F.split(text, ":")[1].cast("bigint") * F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)


def pvalue_label(p: Column) -> Column:
    """Seven decimals without trailing zeros (``1.23e-05`` below a ten-thousandth), or ``<1e-07`` below that."""
    parts = F.round(p * 1e7).cast("bigint")
    digits = parts.cast("string")
    # both spellings come from the same whole number, rounded once; rounding p's own decimals differs beside a half
    plain = F.regexp_replace(F.format_string("%.7f", parts / 1e7), "(\\.[0-9]+?)0+$", "$1")
    tail = F.regexp_replace(F.substring(digits, 2, 10), "0+$", "")
    short = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e-0"), (8 - F.length(digits)).cast("string"))
    return F.when(p < 1e-7, "<1e-07").when(parts < 1000, short).otherwise(plain)


def pvalue_from_label(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "pvalues", -1), "[_<]", "").cast("double")


def similarity(distance: Column, a: Column, b: Column) -> Column:
    return 1 - 2 * distance / (F.length(a) + F.length(b))


def hamming(a: Column, b: Column, compat: bool = False) -> Column:
    """Differing places of equally long strings. compat: 1 if the strings differ at all."""
    if compat:
        return (a != b).cast("int")
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    return F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def sliding_hamming(longer: Column, shorter: Column) -> Column:
    """Fewest differing places over all offsets of the shorter string in the longer."""
    at = F.sequence(F.lit(1), F.length(longer) - F.length(shorter) + 1)
    return F.array_min(F.transform(at, lambda i: hamming(F.substring(longer, i, F.length(shorter)), shorter)))


def query_and_target(a: Column, b: Column) -> Column:
    """The shorter is the query; flag 0 if that is a, else 1 (ties: b)."""
    first = F.length(a) < F.length(b)
    return F.struct(F.when(first, a).otherwise(b).alias("query"), F.when(first, b).otherwise(a).alias("target"), F.when(first, 0).otherwise(1).alias("flag"))


def hit_offsets(qstart: Column, sstart: Column, k: int) -> Column:
    """Where a hit's query lies on its target: first base (1 is first: start - 1 is 0) and bases used."""
    d = sstart - qstart
    return F.struct(F.greatest(d, F.lit(0)).alias("abs_sstart"), (F.lit(k) - F.abs(F.least(d, F.lit(0)))).alias("used_length"))


def iupac(bases: Column) -> Column:
    """Ambiguity code of an array of bases; other letters are ignored."""
    key = F.array_join(F.array_sort(F.array_distinct(F.array_intersect(bases, F.array(*map(F.lit, "ACGT"))))), "")
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.try_element_at(table, key)


def nonzero_fragments(counts: Column, seq: Column, k: int) -> Column:
    """Maximal runs of k-mers with a count over 0: array of (start, seq, counts)."""
    at = F.sequence(F.lit(0), F.size(counts) - 1)
    heads = F.filter(at, lambda i: (counts[i] > 0) & F.when(i == 0, F.lit(True)).otherwise(F.get(counts, i - 1) == 0))
    ends = F.filter(at, lambda i: (counts[i] > 0) & F.coalesce(F.get(counts, i + 1) == 0, F.lit(True)))
    made = F.transform(
        F.arrays_zip(heads.alias("a"), ends.alias("b")),
        lambda r: F.struct(
            r["a"].alias("start"),
            F.substring(seq, r["a"] + 1, r["b"] - r["a"] + k).alias("seq"),
            F.slice(counts, r["a"] + 1, r["b"] - r["a"] + 1).alias("counts"),
        ),
    )
    return F.when(F.size(counts) > 0, made).otherwise(F.slice(made, 1, 0))


def batches(index: Column, size: int) -> Column:
    """Number of the fixed-size chunk that a 0-based row number falls into."""
    return F.floor(index / size)


def name_of(*parts: Column) -> Column:
    """A repeatable eight-letter id."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)


def merge_match(a: Column, b: Column, marks: Column) -> Column:
    """Consensus of two gapped strings: matching places keep a, a gap takes the other's letter, a mismatch becomes a full stop."""
    at = F.sequence(F.lit(1), F.length(marks))
    pick = lambda i: reduce(
        lambda rest, case: F.when(case[0], case[1]).otherwise(rest),
        [
            (F.substring(b, i, F.lit(1)) == "-", F.substring(a, i, F.lit(1))),
            (F.substring(a, i, F.lit(1)) == "-", F.substring(b, i, F.lit(1))),
            (F.substring(marks, i, F.lit(1)) == "|", F.substring(a, i, F.lit(1))),
        ],
        F.lit("."),
    )
    return F.array_join(F.transform(at, pick), "")
