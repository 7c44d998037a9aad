"""Datasets: parts of one graph with shared dictionaries, from files, archives, tables and a catalog of public ones."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode, relational, splitting
from .graph_tables import read_dataset, read_triples, write_dataset
from .staging import staged

#: Name, entities, relations and triples of public datasets, as their publishers count them.
KNOWN = {
    "aristov4": (42016, 1593, 279425), "biokg": (105524, 17, 2067997), "ckg": (7617419, 11, 26691525), "codexlarge": (77951, 69, 612437), "codexmedium": (17050, 51, 206205), "codexsmall": (2034, 42, 36543),
    "conceptnet": (28370083, 50, 34074917), "countries": (271, 2, 1158), "cskg": (2087833, 58, 4598728), "db100k": (99604, 470, 697479), "dbpedia50": (24624, 351, 34421), "drkg": (97238, 107, 5874257),
    "openea": (15000, 248, 38265), "cn3l": (3206, 42, 21777), "wk3l120k": (119748, 3109, 1375406), "wk3l15k": (15126, 1841, 209041), "fb15k": (14951, 1345, 592213), "fb15k237": (14505, 237, 310079),
    "globi": (404207, 39, 1966385), "hetionet": (45158, 24, 2250197), "kinships": (104, 25, 10686), "nations": (14, 55, 1992), "nationsliteral": (14, 55, 1992), "ogbbiokg": (93773, 51, 5088434),
    "ogbwikikg2": (2500604, 535, 17137181), "openbiolink": (180992, 28, 4563407), "openbiolinklq": (480876, 32, 27320889), "pharmebinet": (2869407, 208, 15883653), "pharmkg": (188296, 39, 1093236), "pharmkg8k": (7247, 28, 485787),
    "primekg": (129375, 30, 8100498), "umls": (135, 46, 6529), "wd50kt": (40107, 473, 232344), "wikidata5m": (4594149, 822, 20624239), "wn18": (40943, 18, 151442), "wn18rr": (40559, 11, 92583), "yago310": (123143, 37, 1089000),
}
PARTS = ("training", "testing", "validation")


@dataclass
class Dataset:
    """Labelled triples (h, r, t) of each part; ``literals`` (entity, attribute, value) if there are any. Frames are lazy."""

    parts: dict[str, DataFrame]
    name: str = "dataset"
    metadata: dict[str, str] = field(default_factory=dict)
    literals: DataFrame | None = None

    @property
    def training(self) -> DataFrame:
        return self.parts["training"]

    @property
    def testing(self) -> DataFrame:
        return self.parts["testing"]

    @property
    def validation(self) -> DataFrame | None:
        return self.parts.get("validation")

    def dictionaries(self) -> tuple[DataFrame, DataFrame]:
        """(label, id) of the training part's entities and relations."""
        return encode.entity_dictionary(self.training), encode.relation_dictionary(self.training)

    def encoded(self, inverses: bool = False) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
        """The parts as ids, and both dictionaries. What training doesn't name goes; inverse triples are for training alone."""
        entities, relations = map(staged, self.dictionaries())
        ids = {name: staged(encode.encode(df, entities, relations)) for name, df in self.parts.items()}
        if inverses:
            ids = {name: encode.with_inverses(df) if name == "training" else df.select("h", (F.col("r") * 2).alias("r"), "t") for name, df in ids.items()}
        return ids, entities, relations

    def summary(self) -> DataFrame:
        """part, triples, entities, relations."""

        def row(name: str, df: DataFrame) -> DataFrame:
            ends = df.select(F.explode(F.array("h", "t")).alias("e")).agg(F.count_distinct("e").alias("entities"))
            return df.agg(F.count("*").alias("triples"), F.count_distinct("r").alias("relations")).crossJoin(ends).select(F.lit(name).alias("part"), "triples", "entities", "relations")

        return reduce(DataFrame.unionByName, (row(n, df) for n, df in self.parts.items()))

    def merged(self) -> DataFrame:
        return relational.merge(*self.parts.values())

    def mapped(self, change) -> Dataset:
        """The dataset with ``change`` applied to every part."""
        return Dataset({n: change(df) for n, df in self.parts.items()}, self.name, self.metadata, self.literals)

    def restricted(self, entities: DataFrame | None = None, relations: DataFrame | None = None, invert_entities: bool = False, invert_relations: bool = False) -> Dataset:
        return self.mapped(lambda df: relational.restrict(df, entities=entities, relations=relations, invert_entities=invert_entities, invert_relations=invert_relations))

    def _parted(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df.select("h", "r", "t", F.lit(k).alias("part")) for k, df in enumerate(self.parts.values())))

    def _from_parted(self, rows: DataFrame) -> Dataset:
        rows = staged(rows)
        return Dataset({n: rows.where(F.col("part") == k).select("h", "r", "t") for k, n in enumerate(self.parts)}, self.name, self.metadata, self.literals)

    def remixed(self, seed: int = 0) -> Dataset:
        """All triples dealt anew into parts of the same sizes."""
        return self._from_parted(splitting.remixed(self._parted(), seed))

    def deteriorated(self, share: float, seed: int = 0) -> Dataset:
        """A share of training moved to the other parts."""
        return self._from_parted(splitting.deteriorated(self._parted(), share, seed))

    def similarity(self, other: Dataset) -> float:
        """One less the triples that would have to move between training and the rest, by all triples of both trainings."""
        return float(relational.steps(self.training, other.training).first().similarity)

    def save(self, path: str) -> None:
        """One Parquet table partitioned by part, with metadata beside it."""
        write_dataset(self.parts, f"{path}/triples")
        spark = self.training.sparkSession
        spark.createDataFrame([("name", self.name), *self.metadata.items()], "key string, value string").coalesce(1).write.parquet(f"{path}/metadata")
        if self.literals is not None:
            self.literals.write.parquet(f"{path}/literals")


def load(spark: SparkSession, path: str) -> Dataset:
    """A dataset from ``save``; literals aren't read."""
    metadata = {r.key: r.value for r in spark.read.parquet(f"{path}/metadata").collect()}
    return Dataset(read_dataset(spark, f"{path}/triples"), metadata.pop("name", "dataset"), metadata)


def from_triples(triples: DataFrame, ratios: tuple[float, ...] = (0.8, 0.1), method: str = "coverage", seed: int = 0, name: str = "dataset") -> Dataset:
    """Triples split into training, testing and validation; two ratios leave the rest to validation."""
    rows = staged(splitting.parted(triples, list(ratios), method, seed))
    n = len(splitting.normalized(list(ratios)))
    return Dataset({p: rows.where(F.col("part") == k).select("h", "r", "t") for k, p in enumerate(PARTS[:n])}, name)


def from_path(spark: SparkSession, path: str, ratios: tuple[float, ...] = (0.8, 0.1), seed: int = 0, **reading) -> Dataset:
    """One delimited file, split."""
    return from_triples(read_triples(spark, path, **reading), ratios, seed=seed, name=path.rsplit("/", 1)[-1])


def from_paths(spark: SparkSession, training: str, testing: str, validation: str | None = None, literals: str | None = None, **reading) -> Dataset:
    """A file for each part; rows of testing and validation whose labels training lacks go. ``literals``: a file of entity, attribute, number."""
    known = read_triples(spark, training, **reading)
    entities = known.select(F.explode(F.array("h", "t")).alias("label")).distinct()
    relations = known.select(F.col("r").alias("label")).distinct()
    held = lambda p: relational.restrict(read_triples(spark, p, **reading), entities=entities, relations=relations)
    parts = {"training": known, "testing": held(testing)} | ({"validation": held(validation)} if validation else {})
    numbers = None
    if literals:
        numbers = read_triples(spark, literals, **reading).select(F.col("h").alias("entity"), F.col("r").alias("attribute"), F.col("t").try_cast("double").alias("value")).where("value is not null")
    return Dataset(parts, training.rsplit("/", 1)[-1], literals=numbers)


def archived_triples(spark: SparkSession, path: str, member: str, delimiter: str = "\t", columns: tuple[int, int, int] = (0, 1, 2), header: bool = False, block: int = 50_000) -> DataFrame:
    """Triples of the member of a zip or tar archive (compressed ones too) whose path ends with ``member``.

    Archives are read by Spark's file source and their members line by line on the executors, one archive a task: unpack
    those that are too large for that. Lines of fewer columns go.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(name: str, content: bytes) -> Iterator[str]:
        if re.search(r"\.zip$", name):
            import zipfile

            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for x in archive.namelist():
                    if x.endswith(member):
                        with archive.open(x) as f:
                            yield from io.TextIOWrapper(f, "utf-8")
        else:
            import tarfile

            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                for x in archive:
                    if x.isfile() and x.name.endswith(member):
                        yield from io.TextIOWrapper(archive.extractfile(x), "utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=["h", "r", "t"])

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held, first = [], header
                for line in lines(name, content):
                    if first:
                        first = False
                        continue
                    cells = line.rstrip("\r\n").split(delimiter)
                    if len(cells) > max(columns):
                        held.append(tuple(cells[c] for c in columns))
                    if len(held) >= block:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    return files.mapInArrow(run, "h string, r string, t string")


def from_archive(spark: SparkSession, path: str, members: dict[str, str] | str, ratios: tuple[float, ...] = (0.8, 0.1), seed: int = 0, **reading) -> Dataset:
    """Members by part, or one member that is split."""
    if isinstance(members, str):
        return from_triples(archived_triples(spark, path, members, **reading), ratios, seed=seed, name=members)
    return Dataset({part: archived_triples(spark, path, m, **reading) for part, m in members.items()}, path.rsplit("/", 1)[-1])


def fetched(spark: SparkSession, url: str, path: str, force: bool = False) -> str:
    """The file at a URL as a file below ``path``, which driver and executors share; a file that is there already is not fetched again."""
    import shutil
    import urllib.request

    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{url.rstrip('/').rsplit('/', 1)[-1]}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if force or not fs.exists(target):
        import tempfile

        # on its way through the driver only
        with tempfile.NamedTemporaryFile() as local, urllib.request.urlopen(url) as source:  # noqa: S310
            shutil.copyfileobj(source, local)
            local.flush()
            fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{local.name}"), target)
    return target.toString()


@dataclass
class InductiveDataset:
    """A graph to train on and another, of other entities but the same relations, to predict in."""

    training: DataFrame
    inference: DataFrame
    testing: DataFrame
    validation: DataFrame | None = None

    def encoded(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        """(ids, entity dictionary) by part: training's own entities, and those of the inference graph for the others; relations are training's."""
        relations = staged(encode.relation_dictionary(self.training))
        entities, others = staged(encode.entity_dictionary(self.training)), staged(encode.entity_dictionary(self.inference))
        out = {"training": (encode.encode(self.training, entities, relations), entities)}
        for name in ("inference", "testing", "validation"):
            if (df := getattr(self, name)) is not None:
                out[name] = encode.encode(df, others, relations), others
        return out


def inductive(triples: DataFrame, train_share: float = 0.5, ratios: tuple[float, ...] = (0.8, 0.1), seed: int = 0) -> InductiveDataset:
    """An inductive dataset from one graph, whose entities are parted."""
    rows = staged(splitting.fully_inductive(triples, train_share, seed, list(ratios)))
    part = lambda k: rows.where(F.col("part") == k).select("h", "r", "t")
    return InductiveDataset(part(0), part(1), part(2), part(3) if len(splitting.normalized(list(ratios))) > 2 else None)


def inductive_from_paths(spark: SparkSession, training: str, inference: str, testing: str, validation: str | None = None, **reading) -> InductiveDataset:
    read = lambda p: read_triples(spark, p, **reading)
    return InductiveDataset(read(training), read(inference), read(testing), read(validation) if validation else None)


def known_datasets(spark: SparkSession, pattern: str = ".*", least: int | None = None, most: int | None = None) -> DataFrame:
    """name, entities, relations, triples of public datasets whose name matches and whose number of triples lies in bounds."""
    rows = [(n, *x) for n, x in KNOWN.items() if re.search(pattern, n, re.IGNORECASE) and (least is None or x[2] >= least) and (most is None or x[2] <= most)]
    return spark.createDataFrame(rows, "name string, entities long, relations long, triples long")


def verified(dataset: Dataset, name: str) -> dict[str, tuple[int, int]]:
    """What differs between a dataset and the counts of the public one of that name: (found, expected) by count."""
    every = dataset.merged().distinct()
    found = every.agg(F.count("*").alias("triples"), F.count_distinct("r").alias("relations")).first()
    entities = every.select(F.explode(F.array("h", "t")).alias("e")).distinct().count()
    want = dict(zip(("entities", "relations", "triples"), KNOWN[name], strict=True))
    got = {"entities": entities, "relations": found.relations, "triples": found.triples}
    return {k: (got[k], want[k]) for k in want if got[k] != want[k]}


def get(spark: SparkSession, what, **options) -> Dataset:
    """A dataset from a Dataset, a frame of triples, a folder from ``save`` or a file of triples."""
    if isinstance(what, Dataset):
        return what
    if isinstance(what, DataFrame):
        return from_triples(what, **options)
    if not isinstance(what, str):
        raise TypeError(f"no dataset: {what!r}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{what}/metadata")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return load(spark, what)
    return from_path(spark, what, **options)
