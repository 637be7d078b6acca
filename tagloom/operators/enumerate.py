"""Enumeration of combinatorial libraries: reaction trees on the driver, products as cross joins.

A library's members are the product of its building-block sets by definition: the cross join is the
result here, not a detour.  SMILES come from RDKit if it is installed; ids, building blocks and sizes
do not need it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tagloom.operators.library import SUBSET, Block, Library

FAILED = "ENUMERATION_FAILED"


@dataclass(frozen=True)
class Reactant:
    """What goes into a step: ``static`` SMILES, a building-block ``set`` (or subset), the ``product``
    of an earlier step, or a ``pool`` of which the first available counts."""

    kind: str
    value: str | tuple


@dataclass(frozen=True)
class Step:
    name: str
    step_id: int
    smarts: tuple[str, ...]
    reactants: tuple[Reactant, ...]


@dataclass
class Tree:
    """Steps in order; ``threads``: for each way through pools, the sets it uses and its steps."""

    steps: list[Step]
    threads: list[tuple[frozenset, list[Step]]] = field(default_factory=list)

    def thread_of(self, subset_ids: list[str]) -> list[Step]:
        """The steps for exactly these sets or subsets."""
        want = frozenset(subset_ids)
        for key, steps in self.threads:
            if key == want:
                return steps
        raise KeyError(f"no thread takes {sorted(want)}")


def parse_reactant(text, sets: set[str], products: set[str]) -> Reactant:
    if isinstance(text, list):
        inner = tuple(parse_reactant(t, sets, products) for t in text)
        if any(r.kind == "pool" for r in inner):
            raise ValueError("a pool may not hold a pool")
        return Reactant("pool", inner)
    if text in products:
        return Reactant("product", text)
    if text in sets or text.split(":::")[0] in sets:
        return Reactant("set", text)
    if re.fullmatch(r"[A-Za-z0-9@+\-\[\]()=#$/\\.%*:]+", text):
        return Reactant("static", text)
    raise ValueError(f"reactant {text!r} is no set, product or SMILES")


def build_tree(steps: dict, set_ids: list[str]) -> Tree:
    """A tree from ``reaction_steps``: {name: {step_id, rxn_smarts, reactants}}.

    Every set is used once in a thread; a product is used after its step; keys of threads differ.
    """
    order = sorted(steps.items(), key=lambda kv: kv[1]["step_id"])
    if len({s["step_id"] for _, s in order}) != len(order):
        raise ValueError("step ids repeat")
    made, known = [], set()
    for name, s in order:
        smarts = s["rxn_smarts"] if isinstance(s["rxn_smarts"], list) else [s["rxn_smarts"]]
        labels = {f"product_{x}" for x in known}
        reactants = tuple(parse_reactant(r, set(set_ids), labels | known) for r in s["reactants"])
        made.append(Step(name, s["step_id"], tuple(smarts), reactants))
        known |= {name, str(s["step_id"])}
    tree = Tree(made)
    leaves = [made[-1]] if made else []
    for leaf in leaves:
        for used in _ways(leaf, {s.name: s for s in made} | {f"product_{s.name}": s for s in made} | {f"product_{s.step_id}": s for s in made} | {str(s.step_id): s for s in made}):
            sets = [r for r in used if r[0] == "set"]
            bases = [x.split(":::")[0] for _, x in sets]
            if len(set(bases)) != len(bases):
                raise ValueError("a building-block set is used twice in one thread")
            key = frozenset(x for _, x in sets)
            if any(key == k for k, _ in tree.threads):
                raise ValueError(f"two threads take {sorted(key)}")
            names = {x for kind, x in used if kind == "step"} | {leaf.name}
            tree.threads.append((key, [s for s in made if s.name in names]))
    return tree


def _ways(step: Step, by_name: dict) -> Iterator[list[tuple[str, str]]]:
    """All (kind, name) lists below a step, one for each choice from its pools."""

    def of(r: Reactant) -> list[list[tuple[str, str]]]:
        if r.kind == "set":
            return [[("set", r.value)]]
        if r.kind == "product":
            below = by_name[r.value]
            return [[("step", below.name), *w] for w in _ways(below, by_name)]
        if r.kind == "pool":
            return [w for x in r.value for w in of(x)]
        return [[]]

    ways: list[list[tuple[str, str]]] = [[]]
    for r in step.reactants:
        ways = [a + b for a in ways for b in of(r)]
    yield from ways


def sizes(library: Library, tree: Tree | None = None) -> int:
    """Members without enumerating: product of the sets' real non-null blocks, summed over threads."""
    if tree is None:
        return prod(len([b for b in s.real() if not b.is_null]) for s in library.sets)
    total = 0
    for key, _ in tree.threads:
        chosen = [s.subset(x, drop_null=True) if ":::" in x else [b for b in s.real() if not b.is_null] for x in key for s in library.sets if s.set_id == x.split(":::")[0]]
        total += prod(len(c) for c in chosen)
    return total


def members(blocks: list[DataFrame], library_id: str) -> DataFrame:
    """The product of building-block tables (bb_id, smiles), null blocks dropped, ids joined."""
    parts = []
    for i, b in enumerate(blocks, 1):
        real = b.where(~F.contains(F.lower("bb_id"), F.lit("null")))
        parts.append(real.select(F.col("bb_id").alias(f"BB{i}_ID"), F.col("smiles").alias(f"BB{i}_SMILES")))
    whole = reduce(DataFrame.crossJoin, parts)
    ids = [f"BB{i}_ID" for i in range(1, len(blocks) + 1)]
    pairs = [c for i in range(1, len(blocks) + 1) for c in (f"BB{i}_ID", f"BB{i}_SMILES")]
    return whole.select(F.concat_ws("-", F.lit(library_id), *ids).alias("DEL_ID"), F.lit(library_id).alias("LIB_ID"), *pairs)


def enumerate_library(spark: SparkSession, library: Library, runner: Callable[[list[str]], str | None] | None = None, on_failure: str = "null") -> DataFrame:
    """All members with their SMILES: ``runner`` makes one from the blocks' SMILES (None: failed).

    ``on_failure``: null, drop or raise.  Without a runner SMILES is null.
    """
    if on_failure not in ("null", "drop", "raise"):
        raise ValueError(f"on_failure {on_failure!r}")
    tables = [spark.createDataFrame([(b.bb_id, b.smiles) for b in s.real()], "bb_id string, smiles string") for s in library.sets]
    df = members(tables, library.library_id)
    if runner is None:
        return df.withColumn("SMILES", F.lit(None).cast("string"))
    return run_reactions(df, [f"BB{i}_SMILES" for i in range(1, len(tables) + 1)], runner, on_failure)


def thread_blocks(library: Library, key: frozenset) -> list[list[Block]]:
    """The real non-null blocks that a thread takes, set by set in the library's order; an unused set gives none."""
    taken = {x.split(SUBSET)[0]: x for x in key}
    return [[b for b in (s.subset(taken[s.set_id]) if SUBSET in taken[s.set_id] else s.blocks) if b.is_real and not b.is_null] for s in library.sets if s.set_id in taken]


def enumerate_threads(
    spark: SparkSession, library: Library, tree: Tree, runner_of: Callable[[list[Step], list[str]], Callable[[list[str]], str | None]] | None = None, on_failure: str = "null", threads: list[frozenset] | None = None,
) -> DataFrame:
    """Members thread by thread: each way through the reactions takes its own subsets of the blocks.

    ``runner_of`` makes a thread's runner from its steps and the sets it takes, for instance
    ``rdkit_runner``; ``threads``: only these keys (all).  A column ``thread`` names the subsets.  Threads
    must take all sets, so that members have as many blocks as the library has cycles.
    """
    if on_failure not in ("null", "drop", "raise"):
        raise ValueError(f"on_failure {on_failure!r}")
    parts = []
    for key, steps in tree.threads:
        if threads is not None and key not in threads:
            continue
        blocks = thread_blocks(library, key)
        if len(blocks) != len(library.sets):
            raise ValueError(f"thread {sorted(key)} does not take every set of {library.library_id}")
        df = members([spark.createDataFrame([(b.bb_id, b.smiles) for b in bs], "bb_id string, smiles string") for bs in blocks], library.library_id)
        order = [x for s in library.sets for x in key if x.split(SUBSET)[0] == s.set_id]
        runner = runner_of(steps, order) if runner_of else None
        columns = [f"BB{i}_SMILES" for i in range(1, len(blocks) + 1)]
        made = run_reactions(df, columns, runner, on_failure) if runner else df.withColumn("SMILES", F.lit(None).cast("string"))
        parts.append(made.withColumn("thread", F.lit(",".join(order))))
    if not parts:
        raise KeyError("no such thread")
    return reduce(DataFrame.unionByName, parts)


def run_reactions(df: DataFrame, columns: list[str], runner: Callable[[list[str]], str | None], on_failure: str = "null") -> DataFrame:
    at = [df.columns.index(c) for c in columns]
    schema = StructType([*df.schema.fields, StructField("SMILES", StringType())])  # add() would change the cached schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in at))
            made = [runner(list(r)) if all(x is not None for x in r) else None for r in rows]
            if on_failure == "raise" and None in made:
                raise ValueError(f"no product for row {made.index(None)} of a batch")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "SMILES"])

    out = df.mapInArrow(run, schema)
    return out.where("SMILES IS NOT NULL") if on_failure == "drop" else out


def by_ids(spark: SparkSession, library: Library, bb_ids: list[str], runner: Callable[[list[str]], str | None] | None = None) -> dict:
    """One member by its building-block ids; unknown ids raise."""
    blocks = [s.by_id(i, required=True) for s, i in zip(library.sets, bb_ids, strict=True)]
    smiles = runner([b.smiles for b in blocks]) if runner and all(b.smiles for b in blocks) else None
    return {"DEL_ID": library.compound_id(bb_ids), "SMILES": smiles}


def rdkit_runner(steps: list[Step], order: list[str], pick: int = 1, find: Callable[[str], str] = str) -> Callable[[list[str]], str | None]:
    """A runner for a thread's steps with RDKit: the first reaction that gives a product counts, and of
    that the ``pick``-th fragment.  ``order``: the set ids in the order of the given SMILES.  A reaction
    that ends in .rxn is a file, at the path that ``find`` gives; others are SMARTS."""
    try:
        from rdkit import Chem
        from rdkit.Chem import AllChem
    except ImportError as e:
        raise RuntimeError("SMILES enumeration needs RDKit") from e

    def run(smiles: list[str]) -> str | None:
        have, last = {s.split(":::")[0]: Chem.MolFromSmiles(x) for s, x in zip(order, smiles)}, None
        for step in steps:
            inputs = []
            for r in step.reactants:
                choices = r.value if r.kind == "pool" else (r,)
                mol = next((m for c in choices if (m := Chem.MolFromSmiles(c.value) if c.kind == "static" else have.get(c.value.removeprefix("product_").split(":::")[0])) is not None), None)
                inputs.append(mol)
            if any(m is None for m in inputs):
                return None
            for smarts in step.smarts:
                reaction = AllChem.ReactionFromRxnFile(find(smarts)) if smarts.endswith(".rxn") else AllChem.ReactionFromSmarts(smarts)
                products = reaction.RunReactants(inputs)
                if products:
                    last = products[0][0]
                    Chem.SanitizeMol(last)
                    fragments = Chem.GetMolFrags(last, asMols=True)
                    last = fragments[min(pick, len(fragments)) - 1]
                    break
            else:
                return None
            have[step.name] = have[str(step.step_id)] = last
        return Chem.MolToSmiles(last) if last is not None else None

    return run
