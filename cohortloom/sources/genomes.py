"""Protein rows of annotated genomes in flat files (GenBank format), as a data source of Spark.

Files are read where tasks run, line by line, gzipped or not; of a file only the
features of one record and, if a protein has to be translated, that record's
sequence are held. Small files share a partition, each large one has its own.

A row is a coding feature with its protein, as stated or translated from the
sequence by its location: segments that are joined, on either strand, partial
ends, a reading frame that begins later, and the bacterial start codons. What
can't be read is a row as well, with ``reason`` and no protein: ``format`` for a
record that doesn't end, or whose lines can't be read, ``location``, ``sequence``
where the record has none, ``table`` for a code that isn't known, ``stop`` for a
stop codon inside, ``pseudo`` for a pseudogene, ``empty`` for a file without any
record, ``file`` for one that can't be read.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, contig string, place int, locus_tag string, gene string, protein_id string, product string, location string, first bigint, last bigint, strand int, protein string, reason string"
#: Bytes of files that share a partition.
SHARE = 64 << 20
#: Amino acids by codon, bases in the order t, c, a, g; the bacterial code and its start codons; the code where tga isn't a stop.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_STARTS = frozenset(("ttg", "ctg", "att", "atc", "ata", "atg", "gtg"))
_CODE = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("tcag") for j, b in enumerate("tcag") for k, c in enumerate("tcag")}
_CODES = {"1": _CODE, "11": _CODE, "4": _CODE | {"tga": "W"}}
_PAIRS = str.maketrans("acgtrymkbdhvwsnu", "tgcayrkmvhdbwsna")
_SPAN = re.compile(r"([<>]?)(\d+)(?:\.\.([<>]?)(\d+))?")
#: First and last place from 1, strand, and whether either end is cut off.
Part = tuple[int, int, int, bool, bool]


class BadLocation(ValueError):
    pass


def segments(location: str) -> list[Part]:
    """The parts of a location in reading order."""
    text, at = "".join(location.split()), 0

    def one() -> list[Part]:
        nonlocal at
        for name in ("complement", "join", "order"):
            if text.startswith(name + "(", at):
                at += len(name) + 1
                parts = one()
                while text[at : at + 1] == ",":
                    at += 1
                    parts += one()
                if text[at : at + 1] != ")" or name == "complement" and not parts:
                    raise BadLocation(location)
                at += 1
                return [(a, b, -s, x, y) for a, b, s, x, y in reversed(parts)] if name == "complement" else parts
        m = _SPAN.match(text, at)
        if not m:
            raise BadLocation(location)
        at = m.end()
        a, b = int(m[2]), int(m[4] or m[2])
        if not 1 <= a <= b:
            raise BadLocation(location)
        return [(a, b, 1, bool(m[1]), bool(m[3] or not m[4] and m[1]))]

    found = one()
    if at != len(text):
        raise BadLocation(location)
    return found


def spliced(sequence: str, parts: list[Part]) -> str:
    out = []
    for a, b, strand, *_ in parts:
        if b > len(sequence):
            raise BadLocation(f"{a}..{b}")
        piece = sequence[a - 1 : b]
        out.append(piece if strand > 0 else piece.translate(_PAIRS)[::-1])
    return "".join(out)


def translated(bases: str, table: str, frame: int, whole_start: bool) -> str:
    """The protein without its stop; an unknown codon is X. A start codon reads M unless the beginning is cut off."""
    code = _CODES[table]
    codons = [bases[k : k + 3] for k in range(frame - 1, len(bases) - 2, 3)]
    out = [code.get(c, "X") for c in codons]
    if out and whole_start and frame == 1 and codons[0] in _STARTS:
        out[0] = "M"
    if out and out[-1] == "*":
        out.pop()
    return "".join(out)


@dataclass
class _Feature:
    location: str
    values: dict[str, str] = field(default_factory=dict)


class Parser:
    """Takes the lines of one file; gives its rows record by record."""

    def __init__(self, file: str):
        self.file, self.records = file, 0
        self._reset()

    def _reset(self) -> None:
        self.contig: str | None = None
        self.part, self.features, self.bases, self.needed = "", [], [], False
        self.now: _Feature | None = None
        self.key, self.name = "", ""
        self.broken = False

    def line(self, line: str) -> Iterator[tuple]:
        if line.startswith("LOCUS"):
            if self.contig is not None:
                yield self._reject("format")
                self._reset()
            words = line.split()
            self.contig, self.part = (words[1] if len(words) > 1 else ""), "head"
            self.records += 1
        elif line.startswith("//"):
            if self.contig is not None:
                yield from self._rows()
            self._reset()
        elif self.contig is None:
            return
        elif line.startswith("FEATURES"):
            self.part = "features"
        elif line.startswith("ORIGIN"):
            self._close()
            self.part = "origin"
            self.needed = any("translation" not in f.values and "pseudo" not in f.values and "pseudogene" not in f.values for f in self.features)
        elif line[:1].strip() and self.part in ("features", "origin"):
            self._close()
            self.part = "head"
        elif self.part == "origin":
            if self.needed:
                self.bases.append("".join(line.split()[1:]).lower())
        elif self.part == "features":
            self._feature(line)

    def _feature(self, line: str) -> None:
        key, rest = line[:21].strip(), line[21:].strip()
        if key:
            self._close()
            self.key, self.name, self.now = key, "", _Feature(rest) if key == "CDS" else None
        elif self.now is None:
            return
        elif rest.startswith("/") and not self._open():
            name, _, value = rest[1:].partition("=")
            self.name = name
            self.now.values.setdefault(name, value)
            self.first = self.now.values[name] is value
        elif self.name:
            if self.first:
                glue = "" if self.name == "translation" else " "
                self.now.values[self.name] += glue + rest
        else:
            self.now.location += rest

    def _open(self) -> bool:
        """Whether a quoted value goes on."""
        value = self.now.values.get(self.name, "") if self.now and self.name and self.first else ""
        return value.startswith('"') and (len(value) == 1 or value.count('"') % 2 == 1)

    def _close(self) -> None:
        if self.now is not None:
            self.now.values = {k: v.strip().removeprefix('"').removesuffix('"').replace('""', '"') for k, v in self.now.values.items()}
            self.features.append(self.now)
        self.now = None

    def _reject(self, reason: str) -> tuple:
        return (self.file, self.contig, *[None] * 10, reason)

    def _rows(self) -> Iterator[tuple]:
        self._close()
        sequence = "".join(self.bases)
        for k, f in enumerate(self.features):
            v = f.values
            head = (self.file, self.contig, k, v.get("locus_tag"), v.get("gene"), v.get("protein_id"), v.get("product"), f.location)
            try:
                parts = segments(f.location)
            except BadLocation:
                yield (*head, None, None, None, None, "location")
                continue
            strands = {p[2] for p in parts}
            head = (*head, min(p[0] for p in parts), max(p[1] for p in parts), strands.pop() if len(strands) == 1 else 0)
            yield (*head, *self._protein(f, parts, sequence))

    def _protein(self, f: _Feature, parts: list[Part], sequence: str) -> tuple[str | None, str | None]:
        v = f.values
        if "translation" in v:
            return v["translation"].replace(" ", ""), None
        if "pseudo" in v or "pseudogene" in v:
            return None, "pseudo"
        if not sequence:
            return None, "sequence"
        table, frame = v.get("transl_table", "11"), v.get("codon_start", "1")
        if table not in _CODES or frame not in ("1", "2", "3"):
            return None, "table"
        try:
            bases = spliced(sequence, parts)
        except BadLocation:
            return None, "location"
        cut = parts[0][3] if parts[0][2] > 0 else parts[0][4]
        protein = translated(bases, table, int(frame), not cut)
        return (None, "stop") if "*" in protein else (protein, None)

    def end(self) -> Iterator[tuple]:
        if self.contig is not None:
            yield self._reject("format")
        elif not self.records:
            yield self._reject("empty")


def parsed(file: str, stream: Iterator[str]) -> Iterator[tuple]:
    parser = Parser(file)
    for line in stream:
        yield from parser.line(line.rstrip("\r\n"))
    yield from parser.end()


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = [line.rsplit("\t", 1) for line in options["files"].split("\n") if line]

    def partitions(self) -> list[Files]:
        out, held = [[]], 0
        for path, size in sorted(self.files, key=lambda f: (-int(f[1]), f[0])):
            if out[-1] and held + int(size) > SHARE:
                out.append([])
                held = 0
            out[-1].append(path)
            held += int(size)
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.paths:
            try:
                at = re.sub(r"^file:/(?!/)", "file:///", path)
                system, inside = fs.FileSystem.from_uri(at) if ":" in at else (fs.LocalFileSystem(), at)
                with system.open_input_stream(inside, compression="gzip" if inside.endswith(".gz") else None) as raw:
                    yield from parsed(path, io.TextIOWrapper(io.BufferedReader(_Raw(raw), 1 << 20), encoding="utf-8", errors="replace"))
            except OSError:
                yield (path, *[None] * 11, "file")


class _Raw(io.RawIOBase):
    """An Arrow stream as one of Python's."""

    def __init__(self, stream):  # noqa: ANN001
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:  # noqa: ANN001
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class AnnotatedGenomes(DataSource):
    """Options: ``files``, one a line, each a path, a tab and its size."""

    @classmethod
    def name(cls) -> str:
        return "annotated_genomes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def _listed(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of files below a folder, empty ones included, which Spark's own listing leaves out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        if fnmatch(f.getPath().getName(), pattern):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def proteins(spark: SparkSession, folder: str, pattern: str = "*.gb*") -> DataFrame:
    """The rows of all flat files below a folder, rejects included."""
    files = _listed(spark, folder, pattern)  # names and sizes; contents aren't read
    spark.dataSource.register(AnnotatedGenomes)
    return spark.read.format("annotated_genomes").option("files", "\n".join(f"{path}\t{size}" for path, size in files)).load()
