"""Loaders for libraries, building blocks, tools, selections and settings, and the data folder's catalogue."""

from __future__ import annotations

import csv
import json
import os
import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.decode import Settings
from tagloom.operators.library import Block, BlockSet, Library, Schema, Tool, make_section

FOLDERS = {"libraries": (".json",), "building_blocks": (".csv",), "reactions": (".rxn", ".json"), "tool_compounds": (".json",)}


class DataFolder:
    """Names to files of a data folder with the four known subfolders."""

    def __init__(self, root: str):
        self.root = root

    @classmethod
    def create(cls, root: str) -> DataFolder:
        for name in FOLDERS:
            os.makedirs(os.path.join(root, name), exist_ok=True)
        return cls(root)

    def problems(self) -> list[str]:
        """What is missing of the folder's layout; empty if nothing is."""
        return [f"no folder {n}" for n in FOLDERS if not os.path.isdir(os.path.join(self.root, n))]

    def find(self, kind: str, name: str) -> str:
        """The file of a name; a path that exists stands for itself, several candidates are an error."""
        if os.path.isfile(name):
            return name
        folder = os.path.join(self.root, kind)
        stems = [f for f in (sorted(os.listdir(folder)) if os.path.isdir(folder) else []) if f == name or (os.path.splitext(f)[0] == name and f.endswith(FOLDERS[kind]))]
        if len(stems) != 1:
            raise FileNotFoundError(f"{len(stems)} files for {kind}/{name}")
        return os.path.join(folder, stems[0])


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0].replace(" ", "_")


def load_blocks(path: str, set_id: str | None = None, smiles_required: bool = False) -> BlockSet:
    """A building-block CSV: ``id`` and any of ``tag``, ``smiles``, ``subset_id``; a block may have
    several rows, one for each tag, but tags and other values must not contradict."""
    with open(path, newline="") as f:
        rows = csv.DictReader(f)
        names = [n.strip() for n in rows.fieldnames or []]
        if "id" not in names or set(names) - {"id", "tag", "smiles", "subset_id"} or (smiles_required and "smiles" not in names):
            raise ValueError(f"{path}: header {names}")
        blocks, tags = {}, {}
        for row in rows:
            row = {k.strip(): (v or "").strip() for k, v in row.items() if k}
            block = Block(row["id"], row.get("smiles") or None, row.get("subset_id") or None)
            if blocks.setdefault(block.bb_id, block) != block or (block.bb_id in blocks and not row.get("tag") and blocks[block.bb_id] is not block):
                raise ValueError(f"{path}: building block {block.bb_id} repeats with other values")
            if row.get("tag"):
                tag = row["tag"].upper()
                if tag in tags:
                    raise ValueError(f"{path}: tag {tag} repeats")
                tags[tag] = blocks[block.bb_id]
    return BlockSet(set_id or stem(path), list(blocks.values()), tags)


def load_library(path: str, folder: DataFolder | None = None) -> Library:
    """A library JSON with its building-block sets; the id is the file's stem."""
    folder = folder or DataFolder(os.path.dirname(os.path.dirname(os.path.abspath(path))))
    with open(path) as f:
        data = json.load(f)
    schema = load_schema(data["barcode_schema"]) if "barcode_schema" in data else None
    sets = []
    for entry in sorted(data["bb_sets"], key=lambda e: e["cycle"]):
        where = entry.get("bb_set_path") or folder.find("building_blocks", entry["bb_set_name"])
        sets.append(load_blocks(where, entry.get("bb_set_name")))
    for tool in data.get("doped", []):
        for s, tag in zip(sets, tool.get("tags", [])):
            if tag in s.tags:
                raise ValueError(f"{path}: doped tag {tag} is taken")
            s.tags[tag.upper()] = Block(tool["compound_id"], tool.get("smiles"), tool=tool["compound_id"])
    return Library(stem(path), schema, sets, data.get("scaffold"), data.get("reactions"))


def load_schema(data: dict, tool: bool = False) -> Schema:
    return Schema([make_section(n, s["tag"], s.get("overhang") or "", s.get("error_correction")) for n, s in data.items()], tool)


def load_tool(path: str) -> Tool:
    with open(path) as f:
        data = json.load(f)
    schema = load_schema(data["barcode_schema"], tool=True) if "barcode_schema" in data else None
    return Tool(data.get("compound_id") or stem(path), schema, data.get("smiles"))


@dataclass
class Selection:
    selection_id: str
    libraries: list[Library]
    tools: list[Tool] = field(default_factory=list)
    sequence_files: list[str] = field(default_factory=list)
    settings: Settings = field(default_factory=Settings)
    about: dict = field(default_factory=dict)


def load_selection(path: str, folder: DataFolder) -> Selection:
    """A selection YAML; the id defaults to the file's stem, which is stable between processes."""
    with open(path) as f:
        data = yaml.safe_load(f)
    known = {"selection_id", "libraries", "tool_compounds", "sequence_files", "decode_settings"}
    return Selection(
        str(data.get("selection_id") or stem(path)),
        [load_library(folder.find("libraries", n), folder) for n in data["libraries"]],
        [load_tool(folder.find("tool_compounds", n)) for n in data.get("tool_compounds") or []],
        [p if os.path.isabs(p) else os.path.join(os.path.dirname(path), p) for p in data.get("sequence_files") or []],
        Settings.of(data.get("decode_settings")),
        {k: v for k, v in data.items() if k not in known},
    )


def settings_from_yaml(path: str) -> Settings:
    with open(path) as f:
        return Settings.of(yaml.safe_load(f))


def settings_to_yaml(settings: Settings, path: str) -> None:
    with open(path, "w") as f:
        yaml.safe_dump({"decode_settings": settings.as_dict()}, f, sort_keys=False)


def blocks_table(spark: SparkSession, libraries: list[Library]) -> DataFrame:
    """library_id, cycle, set_id, bb_id, smiles, subset_id, is_null, is_real: one row a building block."""
    rows = [(x.library_id, i, s.set_id, b.bb_id, b.smiles, b.subset, b.is_null, b.is_real) for x in libraries for i, s in enumerate(x.sets, 1) for b in s.blocks]
    return spark.createDataFrame(rows, "library_id string, cycle int, set_id string, bb_id string, smiles string, subset_id string, is_null boolean, is_real boolean")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A building-block CSV as a DataFrame: one row a block with the sorted set of its tags."""
    df = spark.read.csv(path, header=True)
    have = set(df.columns)
    if "id" not in have:
        raise ValueError(f"{path}: no id column")
    extra = [F.first(c, ignorenulls=True).alias(c) for c in ("smiles", "subset_id") if c in have]
    tags = F.sort_array(F.collect_set("tag")) if "tag" in have else F.array().cast("array<string>")
    return df.groupBy("id").agg(tags.alias("tags"), *extra).withColumn("is_null", F.contains(F.lower("id"), F.lit("null")))


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", text)
