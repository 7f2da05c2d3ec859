"""The driver's tables seen as differential expression, metadata, logs and so on.

``Tables`` derives every input lazily. Inputs that the operators expect as
files (facts, results, index, signatures, compounds) are written once per
application below the shared scratch folder and then scanned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.operators import episodes, questions
from doseframe.operators.aggregates import treatment_index
from doseframe.operators.joins import heldout_guard
from doseframe.plans.enrich import Prerank, prerank
from doseframe.schema import DE_SCHEMA, TREATMENT
from doseframe.session import scratch_path
from doseframe.sources.de import scan_de, write_de
from doseframe.sources.results import read_enrichment, read_index, write_enrichment, write_index

ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
FACTS_SCHEMA = T.StructType(
    [
        *DE_SCHEMA.fields,
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("row_key", T.DecimalType(38, 0)),
    ]
)
LEAST_FILES = 16
ROWS_IN_FILE = 100_000
PARAMS = Prerank(permutations=20)
#: Sets grow with the part table; jobs over whole tables of any size score the large ones too.
ALL_SETS = replace(PARAMS, max_size=None)
SIGNATURES = ["economy", "large", "medium", "promo", "small", "standard"]
CELL_LINES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNLISTED"]
THRESHOLD = 0.25
BUDGET = 5

_written: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh scratch folder; a local session that names none gets one of its own."""
    local = "/tmp/checkpoints/doseframe" if spark.sparkContext.master.startswith("local") else None
    return scratch_path(spark, label, local)


def gene_of(part_key: str) -> Column:
    ensembl = F.concat(F.lit("ENSG"), F.lpad(F.col(part_key).cast("string"), 11, "0"))
    return F.when(F.col(part_key) % 3 == 0, ensembl).otherwise(F.concat(F.lit("g"), F.col(part_key).cast("string")))


def file_number(cell_line: str, drug: str, files: int) -> Column:
    """A cell line and drug lie in two neighbouring files, by line number."""
    start = F.conv(F.substring(F.md5(F.concat_ws("/", cell_line, drug).cast("binary")), 1, 6), 16, 10).cast("bigint")
    return ((start + F.col("l_linenumber") % 2) % files).cast("int")


def row_key(cents: Column) -> Column:
    """The row order as one number."""
    digits = [F.lpad(c.cast("string"), n, "0") for c, n in ((F.col("l_orderkey"), 12), (F.col("l_linenumber"), 1), (F.col("l_partkey"), 9), (F.col("l_suppkey"), 7), (cents, 9))]
    return F.concat(*digits).cast("decimal(38,0)")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def written(self, label: str, write: Callable[[str], None]) -> str:
        key = (self.spark.sparkContext.applicationId, self.dir, label)
        if key not in _written:
            path = scratch(self.spark, label)
            write(path)
            _written[key] = path
        return _written[key]

    # Facts

    def files(self) -> int:
        """The number of fact files follows the number of rows."""
        return max(LEAST_FILES, self.raw("lineitem").count() // ROWS_IN_FILE)

    def de_from(self, lines: DataFrame) -> DataFrame:
        """Facts from (a stream of) line items."""
        # The facts come first in every join, so that only a dimension is ever broadcast.
        suppliers = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("drug"))
        # Orders take their customers along, so that customers too many to broadcast cost no shuffle of the facts.
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cell_line"))
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey")
        mark = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
        spread = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10000 + 1
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return (
            lines.join(orders, "l_orderkey")
            .join(suppliers, "l_suppkey")
            .join(nations, "s_nationkey")
            .select(
                gene_of("l_partkey").alias("gene_name"),
                ((cents % 2001 - 1000).cast("double") / F.lit(250.0)).alias("log2FoldChange"),
                F.when(mark % 97 == 0, F.lit(None).cast("double"))
                .when(mark % 89 == 0, F.lit(0.0))
                .otherwise(spread.cast("double") / F.lit(10000.0))
                .alias("padj"),
                F.col("l_quantity").alias("baseMean"),
                "drug",
                F.when(F.col("l_linestatus") == "F", F.lit(0.05)).otherwise(F.lit(5.0)).alias("concentration"),
                "cell_line",
                file_number("cell_line", "drug", self.files()).alias("file_num"),
                *ROW_ORDER,
                row_key(cents).alias("row_key"),
            )
        )

    def de_store(self) -> str:
        """Facts as numbered files; a missing padj is stored as NaN."""

        def write(path: str) -> None:
            derived = self.de_from(self.raw("lineitem"))
            write_de(derived.withColumn("padj", F.coalesce("padj", F.lit(float("nan")))), path, self.files())

        return self.written("de", write)

    def de(self) -> DataFrame:
        return scan_de(self.spark, self.de_store(), FACTS_SCHEMA)

    # Metadata

    def drugs(self) -> DataFrame:
        targets = (
            self.raw("supplier")
            .select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("T"), (F.col("s_suppkey") % 50).cast("string")).alias("t"))
            .groupBy("n_nationkey")
            .agg(F.array_join(F.array_sort(F.collect_set("t")), ", ").alias("targets"))
        )
        key = F.col("n_nationkey")

        def yes(flag: Column) -> Column:
            return F.when(flag, F.lit("yes")).otherwise(F.lit("no"))

        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(targets, "n_nationkey", "left")
            .select(
                F.col("n_name").alias("drug"),
                F.coalesce("targets", F.lit("None")).alias("targets"),
                F.col("r_name").alias("moa-broad"),
                F.concat(F.col("r_name"), F.lit(" class "), (key % 3).cast("string")).alias("moa-fine"),
                yes(key % 2 == 0).alias("human-approved"),
                yes(key % 3 == 0).alias("clinical-trials"),
                F.when(key % 4 != 0, F.concat(F.lit("C"), key.cast("string"))).alias("canonical_smiles"),
                F.when(key % 5 != 0, key.cast("double") * 1000).alias("pubchem_cid"),
                key.cast("bigint").alias("ord"),
            )
        )

    def drug_history(self) -> DataFrame:
        """Drug rows with an outdated row for each drug before the valid one."""
        old = self.drugs().withColumns({"moa-fine": F.lit("unclear"), "targets": F.lit("None")})
        return old.unionByName(self.drugs().withColumn("ord", F.col("ord") + 1000))

    def cells(self) -> DataFrame:
        """One row per cell line and distinct driver mutation, ordered by ``ord``."""
        n = F.col("c_custkey") % 20
        row = (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_mktsegment").alias("cell_name"),
                F.lower("c_mktsegment").alias("Organ"),
                F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("Driver_Gene_Symbol"),
                F.concat(F.lit("p.G"), n.cast("string"), F.lit("V")).alias("Driver_ProtEffect_or_CdnaEffect"),
                F.when(n % 4 == 0, "Missense").when(n % 4 == 1, "Frameshift").when(n % 4 == 2, "Stopgain")
                .otherwise("Deletion").alias("Driver_VarType"),
                F.when(n % 5 != 0, F.when(n % 2 == 0, "Het").otherwise("Hom")).alias("Driver_VarZyg"),
                F.when(n % 4 == 0, "GoF").when(n % 4 == 1, "LoF").alias("Driver_Mech_InferDM"),
                F.when(n % 2 == 0, "Oncogene").otherwise("Suppressor").alias("Driver_GeneType_DM"),
                "c_custkey",
            )
        )
        names = [c for c in row.columns if c != "c_custkey"]
        return row.groupBy(*names).agg(F.min("c_custkey").alias("ord"))

    def genes(self) -> DataFrame:
        ensembl = F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))
        return self.raw("part").select(
            gene_of("p_partkey").alias("gene_symbol"), ensembl.alias("ensembl_id"), F.col("p_partkey").alias("token_id")
        )

    def samples(self) -> DataFrame:
        dose = F.when(F.col("o_orderstatus") == "F", "0.05").otherwise("5.0")
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("smp_"), F.col("o_orderkey").cast("string")).alias("sample"),
                F.col("n_name").alias("drug"),
                F.concat_ws("_", "n_name", dose).alias("drugname_drugconc"),
                F.col("c_mktsegment").alias("cell_line"),
            )
        )

    def metadata_root(self) -> str:
        def write(path: str) -> None:
            for name, table in {
                "gene_metadata": self.genes(),
                "drug_metadata": self.drugs(),
                "cell_line_metadata": self.cells(),
                "sample_metadata": self.samples(),
            }.items():
                table.write.parquet(f"{path}/{name}")

        return self.written("metadata", write)

    # Gene sets and signatures

    def sets(self) -> DataFrame:
        part = self.raw("part")
        gene = gene_of("p_partkey").alias("gene")
        return part.select(F.concat(F.lit("type:"), "p_type").alias("pathway"), gene).unionByName(
            part.select(F.concat(F.lit("brand:"), "p_brand").alias("pathway"), gene)
        )

    def signatures(self) -> DataFrame:
        return self.raw("part").select(F.lower("p_type").alias("signature"), gene_of("p_partkey").alias("gene"))

    def signature_file(self) -> str:
        """One JSON object per line; a gene list is split over lines by ranges of keys so that no line grows with the table."""

        def write(path: str) -> None:
            part = self.raw("part").select(
                F.lower("p_type").alias("s"), gene_of("p_partkey").alias("g"), (F.col("p_partkey") / 1000).cast("bigint").alias("b")
            )
            listed = part.groupBy("s", "b").agg(F.collect_list("g").alias("gs"))
            listed.select(F.to_json(F.create_map("s", "gs"))).write.text(path)

        return self.written("signatures", write)

    def compound_csv(self) -> str:
        def write(path: str) -> None:
            self.raw("part").select(
                F.col("p_partkey").alias("DRUG_ID"),
                F.col("p_name").alias("DRUG_NAME"),
                F.col("p_brand").alias("TARGET"),
                F.col("p_type").alias("TARGET_PATHWAY"),
            ).write.csv(path, header=True)

        return self.written("compounds", write)

    def compounds(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("DRUG_ID"),
            F.col("p_name").alias("DRUG_NAME"),
            F.col("p_brand").alias("TARGET"),
            F.col("p_type").alias("TARGET_PATHWAY"),
        )

    def external_names(self) -> DataFrame:
        """Names of an outside table: half of them agree with ours once normalised, the others carry a suffix."""
        name = F.translate(F.upper("p_name"), " ", "-")
        return self.raw("part").select(
            F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.concat(name, F.lit("-EXT"))).alias("external_name")
        )

    def response(self) -> DataFrame:
        return self.de().select(
            F.col("drug").alias("DRUG_NAME"), F.lower("cell_line").alias("CELL_LINE_NAME"),
            F.col("log2FoldChange").alias("LN_IC50"), "l_orderkey", "l_linenumber",
        )

    # Results

    def index_path(self) -> str:
        return self.written("index", lambda path: write_index(self.de(), path))

    def places(self) -> DataFrame:
        """The stored index: every file of every treatment."""
        return read_index(self.spark, self.index_path())

    def index(self) -> DataFrame:
        return treatment_index(self.places())

    def enrichment_path(self) -> str:
        return self.written("enrichment", lambda path: write_enrichment(prerank(self.de(), self.sets(), "row_key", PARAMS), path))

    def enrichment(self) -> DataFrame:
        """Results of all treatments, computed once and read from storage."""
        return read_enrichment(self.spark, self.enrichment_path())

    # Questions

    def questions(self) -> DataFrame:
        asked = (
            self.de_with_part()
            .select("drug", "concentration", F.concat(F.lit("type:"), "p_type").alias("target_pathway"))
            .distinct()
            .withColumn("direction", F.explode(F.array(*[F.lit(d) for d in questions.DIRECTIONS])))
        )
        text = F.concat(
            F.lit("What determines if a cell line shows "), "target_pathway", F.lit(" "), "direction",
            F.lit(" by "), "drug", F.lit(" at "), F.col("concentration").cast("string"), F.lit("uM?"),
        )
        return questions.with_question_id(
            asked.withColumns({"question": text, "fdr_threshold": F.lit(THRESHOLD)})
        )

    def de_with_part(self) -> DataFrame:
        return self.de().join(self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")

    def items(self) -> DataFrame:
        return questions.build_questions(self.questions(), self.enrichment())

    def predictions(self) -> DataFrame:
        """A made-up answer per item at five checkpoints."""
        parity = (F.length("cell_line") + F.length("target_pathway") + F.col("t")) % 2
        return self.items().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("prediction", parity == 1)

    # Episode logs

    def heldout(self) -> DataFrame:
        return self.index().where("cell_line = 'BUILDING' AND concentration = 5.0").select(*TREATMENT)

    def log_from(self, events: DataFrame) -> DataFrame:
        """Action log from (a stream of) events."""
        action = (
            F.when(F.col("event_type") == "signup", "hypothesis")
            .when(F.col("event_type") == "click", "experiment")
            .when(F.col("event_type") == "view", "interpretation")
            .when(F.col("event_type") == "purchase", "knowledge")
            .otherwise("lookup")
        )
        n = F.col("event_id")
        lines = F.array(*[F.lit(c) for c in CELL_LINES])
        asked = events.select(
            F.col("user_id").alias("episode"),
            "ts",
            "event_id",
            action.alias("action"),
            F.concat(F.lit("NATION_"), (n % 27).cast("string")).alias("drug"),
            F.when(n % 2 == 0, F.lit(0.05)).otherwise(F.lit(5.0)).alias("concentration"),
            F.element_at(lines, (F.floor(n / 27) % 6 + 1).cast("int")).alias("cell_line"),
            ((F.col("event_type") == "purchase") & (n % 50 == 0)).alias("declares_done"),
            ((n % 101).cast("double") / F.lit(100.0)).alias("score"),
            F.concat(F.lit("note "), n.cast("string")).alias("note"),
        )
        drug = self.raw("nation").select(F.col("n_name").alias("drug"), F.lit(True).alias("_d"))
        line = self.cells().select(F.col("cell_name").alias("cell_line")).distinct().withColumn("_c", F.lit(True))
        known = asked.join(drug, "drug", "left").join(line, "cell_line", "left")
        guarded = heldout_guard(known, self.heldout())
        results = self.enrichment().select(*TREATMENT).distinct().withColumn("_r", F.lit(True))
        return (
            guarded.join(results, TREATMENT, "left")
            .withColumns({"known_names": F.coalesce(F.col("_d") & F.col("_c"), F.lit(False)), "has_results": F.coalesce("_r", F.lit(False))})
            .drop("_d", "_c", "_r")
        )

    def log(self) -> DataFrame:
        return self.log_from(self.raw("events"))

    def accepted(self) -> DataFrame:
        return episodes.replay_episodes(self.log(), BUDGET, carry=episodes.DETAILS).where("accepted")

    def episode_predictions(self) -> DataFrame:
        n = F.col("event_id")
        return self.raw("events").select(
            F.col("user_id").alias("episode"), (n % 5).alias("t"), (n % 3 == 0).alias("prediction"), (n % 2 == 0).alias("ground_truth")
        )
