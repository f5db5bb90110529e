"""Sequence, k-mer and scaling expressions as native columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complement of each base, and the lowest base of each ambiguity code.
COMPLEMENT = ("ACGT", "TGCA")
AMBIGUOUS = ("MRWSYKVHDBN", "AAACCGAAACA")
RANK4, RANK5 = ("ACGT", "0123"), ("ACGMT", "01234")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def disambiguate(seq: Column) -> Column:
    """Upper case, each ambiguity code as its lowest base."""
    return F.translate(F.upper(seq), *AMBIGUOUS)


def methylate(seq: Column) -> Column:
    return F.replace(seq, F.lit("CG"), F.lit("MG"))


def reverse_complement_methylated(seq: Column) -> Column:
    """Reverse complement in which methylated sites stay methylated, at their place on the other strand, and others stay as they are. An M that ends the sequence is the first half of a site, whose other half is a G."""
    marked = F.replace(seq, F.lit("MG"), F.lit("12"))
    return F.reverse(F.translate(marked, "ACGT12M", "TGCAGMG"))


#: The bases each ambiguity code stands for.
SYMBOLS = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}


def is_valid(seq: Column) -> Column:
    """Whether all letters are bases or ambiguity codes."""
    return seq.rlike(f"^[{''.join(SYMBOLS)}]*$")


def ambiguous_count(seq: Column) -> Column:
    return F.length(F.translate(seq, "ACGT", "")).cast("bigint")


def expansions(kmer: Column) -> Column:
    """All sequences that an ambiguous one stands for, in order; none if a letter is no code. Their number is the product over the letters, so give it k-mers."""
    table = F.create_map(*[x for c, bases in SYMBOLS.items() for x in (F.lit(c), F.array(*[F.lit(b) for b in bases]))])
    grown = F.aggregate(F.split(kmer, ""), F.array(F.lit("")), lambda a, c: F.flatten(F.transform(a, lambda x: F.transform(F.coalesce(table[c], F.array().cast("array<string>")), lambda s: F.concat(x, s)))))
    return F.when(kmer == "", F.array(F.lit(""))).otherwise(grown)


def dna(seq: Column) -> Column:
    return F.replace(seq, F.lit("U"), F.lit("T"))


def kmer_rank(kmer: Column, alphabet: int = 4) -> Column:
    """Lexicographic rank; five letters include M."""
    return F.conv(F.translate(kmer, *(RANK4 if alphabet == 4 else RANK5)), alphabet, 10).cast("bigint")


def over_bases(seq: Column, body) -> Column:
    """body over the array of bases, which is split once: a substring at i would walk i bytes each time."""
    return F.get(F.transform(F.array(F.split(seq, "")), body), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none for a shorter sequence."""
    every = over_bases(seq, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (k - 1)), lambda i: F.array_join(F.slice(c, i, k), "")))
    return F.when(F.length(seq) >= k, every).otherwise(F.array().cast("array<string>"))


def flip_kmer(position: Column, length: Column, k: int) -> Column:
    return length - position - k


def cpg_positions(seq: Column) -> Column:
    """0-based positions of CG."""
    found = over_bases(seq, lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 2), lambda i: (F.get(c, i) == "C") & (F.get(c, i + 1) == "G")))
    return F.when(F.length(seq) >= 2, found).otherwise(F.array().cast("array<int>"))


def picoampere(samples: Column, digitisation: Column, offset: Column, range_: Column) -> Column:
    """Raw samples in pA, in single precision."""
    unit = (range_ / digitisation).cast("float")
    return F.transform(samples, lambda x: ((x.cast("float") + offset.cast("float")) * unit).cast("float"))


def scaled_model(mean: Column, stdv: Column, shift: Column, scale: Column, var: Column) -> tuple[Column, Column]:
    return scale * mean + shift, stdv * var


def z_score(level: Column, mean: Column, stdv: Column, shift: Column, scale: Column, var: Column) -> Column:
    m, s = scaled_model(mean, stdv, shift, scale, var)
    return F.when(s != 0, (level - m) / s)


def level_in_model_units(level: Column, shift: Column, scale: Column) -> Column:
    return F.when(scale != 0, (level - shift) / scale)


def quantised(samples: Column, bits: int) -> Column:
    """Samples with the low bits rounded half up to zero."""
    if bits < 1:
        return samples
    return F.transform(samples, lambda x: F.shiftleft(F.shiftright(x.cast("int") + (1 << (bits - 1)), bits), bits).cast("short"))


def detect_pore(kit: Column) -> Column:
    k = F.lower(kit)
    return F.when(F.contains(k, F.lit("114")), "r10").when(F.contains(k, F.lit("rna004")), "rna004").otherwise("r9")


def detect_run(attributes):
    """file, rna, pore and warnings of every signal file, from the attributes of its read groups (file, read_group, experiment_type, sequencing_kit).

    Read group 0 decides. Without an experiment type, or with an unknown one, it is DNA; a kit with 114 in its name is r10, with rna004 rna004, any other, or none, r9. What is missing, unknown, or different in another group is a warning."""
    at0 = lambda c: F.max(F.when(F.col("read_group") == 0, F.col(c)))
    first = attributes.groupBy("file").agg(at0("experiment_type").alias("experiment"), at0("sequencing_kit").alias("kit"), F.collect_set(F.struct("read_group", "experiment_type", "sequencing_kit")).alias("groups"))
    differ = lambda own, c: F.exists("groups", lambda g: (g["read_group"] > 0) & own.isNotNull() & ~g[c].eqNullSafe(own))
    experiment, kit = F.col("experiment"), F.col("kit")
    said = F.array(
        F.when(experiment.isNull(), "no experiment type"), F.when(~experiment.isin("genomic_dna", "rna"), "unknown experiment type"), F.when(differ(experiment, "experiment_type"), "experiment types differ"),
        F.when(kit.isNull(), "no sequencing kit"), F.when(differ(kit, "sequencing_kit"), "sequencing kits differ"),
    )
    pore = F.when(F.contains(kit, F.lit("114")), "r10").when(F.contains(kit, F.lit("rna004")), "rna004").otherwise("r9")
    return first.select("file", F.coalesce(experiment == "rna", F.lit(False)).alias("rna"), pore.alias("pore"), F.array_compact(said).alias("warnings"))


def reversed_events(events: Column) -> Column:
    """Events of RNA, which goes through the pore from its end, in the order of the sequence."""
    return F.reverse(events)


def reversed_map(ranges: Column) -> Column:
    """k-mers' ranges of events (start, stop) in the opposite order of k-mers, each from its other end."""
    return F.transform(F.reverse(ranges), lambda r: F.struct(r["stop"].alias("start"), r["start"].alias("stop")))


def is_label(name: Column) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def length_bin(length: Column, size: int) -> Column:
    return (F.floor(length / size) * size).cast("bigint")


def level_sum(levels: list[int], k: int):
    """A function of a column of ACGT sequences: the sum of the model's levels over all their k-mers, and the number of k-mers. levels: by rank, 4 ** k of them.

    Array code on batches: ranks are sums of shifted codes of the letters, a few passes over a batch's bytes, where a native aggregate takes a step of interpreted code per base."""
    table = np.asarray(levels, dtype=np.int64)
    codes = np.zeros(256, dtype=np.int64)
    codes[[ord(c) for c in "ACGT"]] = range(4)

    def one(seq):
        c = codes[np.frombuffer(seq.encode(), dtype=np.uint8)] if seq else codes[:0]
        n = max(len(c) - k + 1, 0)
        ranks = np.zeros(n, dtype=np.int64)
        for j in range(k):
            ranks = ranks * 4 + c[j : j + n]
        return int(table[ranks].sum()), n

    @F.pandas_udf("level_sum bigint, n bigint")
    def summed(seqs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in seqs], columns=["level_sum", "n"])

    return summed


def lenient_kmer_rank(kmer: Column) -> Column:
    """The rank with every letter that is no base taken as A."""
    return kmer_rank(F.regexp_replace(kmer, "[^ACGT]", "A"))


def standardised_level(level: Column, mean: Column, stdv: Column, var: Column) -> Column:
    """Distance from the model in its deviations. Division as IEEE has it: a model without deviation gives an infinity, or NaN for no distance."""
    distance, unit = (level - mean).cast("double"), (F.sqrt(var) * stdv).cast("double")
    without = F.when(distance > 0, float("inf")).when(distance < 0, float("-inf")).otherwise(float("nan"))
    return F.when(unit == 0, without).otherwise(distance / F.nullif(unit, F.lit(0.0)))


def scaled_samples(samples: Column, start: Column, length: Column, shift: Column, scale: Column) -> Column:
    """The samples of an event in units of the model. start counts from 0."""
    return F.transform(F.slice(samples, start + 1, length), lambda x: (x - shift) / scale)


def duration_seconds(length: Column, sample_rate: Column) -> Column:
    return length / sample_rate


def upper_median(values: Column) -> Column:
    """The value with half of the others, rounded down, below it; null if there are none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def scaled_mad(values: Column) -> Column:
    """Median distance from the median, as a deviation of normal values."""
    middle = upper_median(values)
    return upper_median(F.transform(values, lambda x: F.abs(x - middle))) * 1.4826


def quantile(values: Column, q: float) -> Column:
    """The q-th quantile with linear interpolation between neighbours; null if there are no values."""
    ordered, at = F.array_sort(values), (F.size(values) - 1) * F.lit(q)
    low = F.get(ordered, F.floor(at).cast("int"))
    return low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at))
