"""Domain tables (companies, filings, facts, chunks, vectors, evaluation and experiment inputs) from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity


class Domain:
    """Lazily planned domain tables of one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def companies(self) -> DataFrame:
        return self.raw("customer").select(
            identity.zero_padded(F.col("c_custkey"), 10).alias("cik"),
            F.col("c_name").alias("legal_name"),
            identity.zero_padded(F.col("c_nationkey"), 4).alias("sic"),
        )

    def filings(self) -> DataFrame:
        year = F.year("o_orderdate")
        form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
        cik = identity.zero_padded(F.col("o_custkey"), 10)
        accession = F.concat(cik, F.lit("-"), identity.zero_padded(year % 100, 2), F.lit("-"), identity.zero_padded(F.col("o_orderkey"), 6))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("filing_id"),
            cik.alias("cik"),
            accession.alias("accession_number"),
            form.alias("form_type"),
            F.to_date("o_orderdate").alias("filing_date"),
            F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        )

    def facts_raw(self, filings: DataFrame | None = None) -> DataFrame:
        """Facts of all filings, or of some rows of ``filings()``."""
        year = F.year("l_shipdate")
        lines = self.raw("lineitem").withColumn("fiscal_year", year)
        joined = lines.join(self.filings() if filings is None else filings, lines["l_orderkey"] == F.col("filing_id"))
        return joined.select(
            "cik",
            F.when(F.col("l_linestatus") == "F", "us-gaap").otherwise("dei").alias("taxonomy"),
            F.concat(F.lit("Flag"), "l_returnflag").alias("concept"),
            F.lit("USD").alias("unit"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
            F.make_date("fiscal_year", F.lit(1), F.lit(1)).alias("start_date"),
            F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("end_date"),
            F.col("filing_date").alias("filed_date"),
            "fiscal_year",
            F.lit("FY").alias("fiscal_period"),
            "form_type",
            "accession_number",
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("source_order"),
        ).withColumn("observation_key", identity.observation_key())

    def sections(self, few: DataFrame | None = None) -> DataFrame:
        """All sections, or those of ``few(doc_id)``, whose texts are broadcast, so that neither texts nor filings are exchanged."""
        docs = self.raw("documents")
        if few is not None:
            docs = F.broadcast(docs.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi"))
        return docs.join(self.filings(), docs["doc_id"] == F.col("filing_id")).select(
            "doc_id", "cik", "accession_number", "form_type", "filing_date", F.col("source").alias("section_name"), F.col("text").alias("content")
        )

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")).alias("embedding_model")
        )

    def judgments(self) -> DataFrame:
        """``case_id, doc_id, grade``: a labelled document belongs to the case that its id selects."""
        n = self.raw("benchmark").agg(F.count(F.lit(1)).alias("n_cases"))
        docs = self.raw("documents").select("doc_id").join(self.raw("labels"), "doc_id").crossJoin(F.broadcast(n))
        return docs.select(F.expr("doc_id % n_cases").alias("case_id"), "doc_id", F.expr("1 + quality + (1 - toxic)").alias("grade"))

    def ranked(self, system: str) -> DataFrame:
        """``case_id, doc_id, rank``: what a system retrieved, ``control`` by length, ``treatment`` by quality first."""
        n = self.raw("benchmark").agg(F.count(F.lit(1)).alias("n_cases"))
        docs = self.raw("documents").select("doc_id", "n_chars").join(self.raw("labels").select("doc_id", "quality"), "doc_id", "left")
        docs = docs.crossJoin(F.broadcast(n)).withColumn("case_id", F.expr("doc_id % n_cases"))
        order = "n_chars desc, doc_id" if system == "control" else "coalesce(quality, 0) desc, n_chars desc, doc_id"
        return docs.selectExpr("case_id", "doc_id", f"cast(row_number() over (partition by case_id order by {order}) as int) as rank")

    def user_events(self) -> DataFrame:
        return self.raw("events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("unit_id"), "event_id", "ts", "event_type", "value")
