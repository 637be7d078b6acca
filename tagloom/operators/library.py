"""Libraries: barcode layouts, building blocks, tool compounds.  Small driver-side objects."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBSET = ":::"
KINDS = ("static", "library", "bb", "umi", "tool", "variable", "mixed")


@dataclass(frozen=True)
class Section:
    name: str
    kind: str
    tag: str
    overhang: str = ""
    mode: str | None = None
    cycle: int | None = None

    def __post_init__(self):
        allowed = {"static": "ACGT", "library": "ACGT", "tool": "ACGT", "bb": "N", "umi": "N", "variable": "N", "mixed": "ACGTN"}[self.kind]
        if not self.tag or set(self.tag) - set(allowed):
            raise ValueError(f"section {self.name}: tag {self.tag!r} may only hold {allowed}")

    @property
    def dna(self) -> str:
        return self.tag + self.overhang


def make_section(name: str, tag: str, overhang: str = "", mode: str | None = None) -> Section:
    """Name and tag decide the kind: library, umi, bb<n>, tool_compound_ref, and by the tag the rest."""
    name = name.replace(" ", "_").replace("-", "_")
    tag, overhang = tag.upper(), (overhang or "").upper()
    cycle = re.fullmatch(r"bb(\d+)", name)
    if name == "library":
        kind = "library"
    elif name == "umi":
        kind = "umi"
    elif name == "tool_compound_ref":
        kind = "tool"
    elif cycle:
        kind = "bb"
    else:
        kind = "variable" if set(tag) == {"N"} else "mixed" if "N" in tag else "static"
    return Section(name, kind, tag, overhang, mode, int(cycle[1]) if cycle else None)


class Schema:
    """An ordered barcode layout with the span of every section."""

    def __init__(self, sections: list[Section], tool: bool = False):
        names = [s.name for s in sections]
        if len(set(names)) != len(names):
            raise ValueError("section names repeat")
        count = lambda k: sum(s.kind == k for s in sections)
        if count("library") != 1 or count("umi") != 1:
            raise ValueError("a layout has one library and one umi section")
        cycles = [s.cycle for s in sections if s.kind == "bb"]
        if not tool and (not cycles or cycles != list(range(1, len(cycles) + 1))):
            raise ValueError("building-block sections must be bb1, bb2, ... in order")
        if tool and count("tool") != 1:
            raise ValueError("a tool layout has one tool_compound_ref section")
        self.sections, self.by_name, self.spans, at = sections, {s.name: s for s in sections}, {}, 0
        for s in sections:
            self.spans[s.name] = (at, at + len(s.tag), at + len(s.dna))
            at += len(s.dna)
        self.length = at
        need = [self.spans[s.name] for s in sections if s.kind in ("library", "umi", "bb", "tool")]
        self.required = (need[0][0], need[-1][2])

    @property
    def min_length(self) -> int:
        return self.required[1] - self.required[0]

    @property
    def statics(self) -> list[Section]:
        return [s for s in self.sections if s.kind == "static"]

    @property
    def blocks(self) -> list[Section]:
        return [s for s in self.sections if s.kind == "bb"]

    def distance(self, a: str, b: str) -> int:
        """Bases between two sections; negative if b comes first."""
        (a0, _, a2), (b0, _, b2) = self.spans[a], self.spans[b]
        return b0 - a2 if b0 >= a2 else -(a0 - b2) - 1


@dataclass(frozen=True)
class Block:
    bb_id: str
    smiles: str | None = None
    subset: str | None = None
    tool: str | None = None  # the tool compound that this block stands for, if it is a doped one

    @property
    def is_null(self) -> bool:
        return "null" in self.bb_id.lower()

    @property
    def is_real(self) -> bool:
        return self.tool is None


@dataclass
class BlockSet:
    set_id: str
    blocks: list[Block]
    tags: dict[str, Block] = field(default_factory=dict)

    def __post_init__(self):
        ids = [b.bb_id for b in self.blocks]
        if len(set(ids)) != len(ids):
            raise ValueError(f"{self.set_id}: building-block ids repeat")
        if ":::" in self.set_id:
            raise ValueError(f"{self.set_id}: a set id may not look like a subset id")
        subsets = {b.subset is None for b in self.blocks}
        if len(subsets) > 1:
            raise ValueError(f"{self.set_id}: all building blocks have a subset or none has")
        if len({len(t) for t in self.tags}) > 1:
            raise ValueError(f"{self.set_id}: tags differ in length")

    def real(self) -> list[Block]:
        return [b for b in self.blocks if b.is_real]

    def non_null(self) -> list[Block]:
        return [b for b in self.blocks if not b.is_null]

    def subset(self, subset_id: str, drop_null: bool = False) -> list[Block]:
        """Blocks of ``set:::subset``, or of a subset's own name."""
        name = subset_id.split(":::")[-1]
        return [b for b in self.blocks if b.subset == name and not (drop_null and b.is_null)]

    def by_id(self, bb_id: str, required: bool = False) -> Block | None:
        found = next((b for b in self.blocks if b.bb_id == bb_id), None)
        if found is None and required:
            raise KeyError(f"{self.set_id} has no building block {bb_id}")
        return found


def subset_id(set_id: str, subset: str | None) -> str:
    return set_id if subset is None else f"{set_id}{SUBSET}{subset}"


def is_null_block(bb_id: Column) -> Column:
    """``Block.is_null`` of a column of ids."""
    return F.contains(F.lower(bb_id), F.lit("null"))


def subset_reference_of(set_id: Column, subset: Column) -> Column:
    """``subset_id`` of two columns."""
    return F.when(subset.isNull(), set_id).otherwise(F.concat(set_id, F.lit(SUBSET), subset))


def compound_id_of(library_id: Column, bb_ids: Column) -> Column:
    """``Library.compound_id`` of a column of library ids and an array of building-block ids."""
    return F.concat_ws("-", library_id, bb_ids)


def subset_parts(reference: Column) -> tuple[Column, Column]:
    """Set and subset of a column of references; no subset: null."""
    parts = F.split(reference, SUBSET)
    return F.get(parts, 0), F.get(parts, 1)


@dataclass(eq=False)
class Library:
    library_id: str
    schema: Schema | None
    sets: list[BlockSet]
    scaffold: str | None = None
    reactions: dict | None = None

    def __post_init__(self):
        if len(self.sets) < 2:
            raise ValueError(f"{self.library_id}: two cycles at least are needed")
        if self.schema is not None:
            if len(self.schema.blocks) != len(self.sets):
                raise ValueError(f"{self.library_id}: {len(self.schema.blocks)} building-block sections, {len(self.sets)} sets")
            for section, s in zip(self.schema.blocks, self.sets):
                if any(len(t) != len(section.tag) for t in s.tags):
                    raise ValueError(f"{self.library_id}: tags of {s.set_id} do not fit section {section.name}")

    @property
    def size(self) -> int:
        return prod(len(s.real()) for s in self.sets)

    @property
    def barcodes(self) -> int:
        return prod(len(s.tags) for s in self.sets)

    @property
    def tag(self) -> str:
        return next(s.dna for s in self.schema.sections if s.kind == "library")

    def compound_id(self, bb_ids: list[str]) -> str:
        return "-".join([self.library_id, *bb_ids])


@dataclass(eq=False)
class Tool:
    """A tool compound: a library of one for demultiplexing."""

    compound_id: str
    schema: Schema | None = None
    smiles: str | None = None

    @property
    def library_id(self) -> str:
        return self.compound_id

    @property
    def tag(self) -> str:
        return next(s.dna for s in self.schema.sections if s.kind == "library")


def check_collection(libraries: list) -> None:
    """Ids and DNA tags have to be unique."""
    for what, values in (("ids", [x.library_id for x in libraries]), ("tags", [(x.tag if x.schema else x.library_id) for x in libraries])):
        if len(set(values)) != len(values):
            raise ValueError(f"library {what} repeat")
