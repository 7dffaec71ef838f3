"""Text keys: slugs, whole-word tokens, accessions and names from paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends; ``unknown`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s.isNull() | (s == ""), "unknown").otherwise(s)


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def pair_name(first: str, second: str) -> str:
    """``a_vs_b`` of two names; neither may be empty."""
    sides = [_plain(first), _plain(second)]
    if not all(sides):
        raise ValueError(f"a name is empty: {first!r}, {second!r}")
    return "_vs_".join(sides)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def has_token(c: Column, token: str) -> Column:
    """Whether a whole word equals ``token``, in any case; null is False."""
    return F.coalesce(F.array_contains(words(c), token.strip().lower()), F.lit(False))


def mentions(c: Column, part: str) -> Column:
    """Contains ``part`` in any case; null is False."""
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def truthy(c: Column) -> Column:
    """``true``, ``1`` or ``yes`` in any case; null is False."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def base_accession(c: Column) -> Column:
    return F.substring_index(c, "_", 2)


def lookup_key(c: Column) -> Column:
    """Accessions that begin with GC are cut to their first two parts."""
    return F.when(c.startswith("GC"), base_accession(c)).otherwise(c)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def parent_name(c: Column) -> Column:
    """Name of the folder that a path lies in."""
    return F.element_at(F.split(c, "/"), -2)


def assembly_id(path: Column) -> Column:
    """Name without ``.fa.gz`` and ``.fna.gz``, wherever they stand; a plain ``.fa`` stays."""
    return F.replace(F.replace(basename(path), F.lit(".fa.gz"), F.lit("")), F.lit(".fna.gz"), F.lit(""))


def annotation_id(path: Column) -> Column:
    """Name up to the first ``.gff``."""
    return F.substring_index(basename(path), ".gff", 1)


def bakta_id(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.bakta\.gff3\.gz$", "")


def without_prefix(c: Column, base: str) -> Column:
    """Removes every occurrence of a base path."""
    return F.replace(c, F.lit(base), F.lit(""))


def stem_without(path: Column, part: str) -> Column:
    """Name without its last extension and without ``part`` wherever it stands."""
    return F.replace(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", ""), F.lit(part), F.lit(""))


def run_names(first: str, second: str, base: str, rate: float, output: str = "finetuned") -> dict[str, str]:
    """Folders and names of a training run on two categories; a caller replaces those that are stated otherwise."""
    pair = pair_name(first, second)
    folder = f"{base.rstrip('/')}/training_{_plain(first)}_{_plain(second)}"
    return {
        "train": f"{folder}/train", "validate": f"{folder}/validate", "sheet": f"{folder}/binary_{pair}_with_split.csv",
        "output": f"{folder}/{output}_lr_{rate}", "label": f"{pair}_label", "suffix": f"_with_{pair}.pt",
    }
