"""CSV scan and sinks (S1-S3). The schema is declared, never inferred, so a scan
is one pass and types do not depend on the rows sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.sources.tables import temporary

# fixed values: the 35 columns of the employee table, in file order, with their types
_HR_COLUMNS = [
    ("Age", "int"), ("Attrition", "string"), ("BusinessTravel", "string"), ("DailyRate", "int"),
    ("Department", "string"), ("DistanceFromHome", "int"), ("Education", "int"),
    ("EducationField", "string"), ("EmployeeCount", "int"), ("EmployeeNumber", "int"),
    ("EnvironmentSatisfaction", "int"), ("Gender", "string"), ("HourlyRate", "int"),
    ("JobInvolvement", "int"), ("JobLevel", "int"), ("JobRole", "string"), ("JobSatisfaction", "int"),
    ("MaritalStatus", "string"), ("MonthlyIncome", "int"), ("MonthlyRate", "int"),
    ("NumCompaniesWorked", "int"), ("Over18", "string"), ("OverTime", "string"),
    ("PercentSalaryHike", "int"), ("PerformanceRating", "int"), ("RelationshipSatisfaction", "int"),
    ("StandardHours", "int"), ("StockOptionLevel", "int"), ("TotalWorkingYears", "int"),
    ("TrainingTimesLastYear", "int"), ("WorkLifeBalance", "int"), ("YearsAtCompany", "int"),
    ("YearsInCurrentRole", "int"), ("YearsSinceLastPromotion", "int"), ("YearsWithCurrManager", "int"),
]

_TYPES = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}

HR_SCHEMA = T.StructType([T.StructField(n, _TYPES[t], True) for n, t in _HR_COLUMNS])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = HR_SCHEMA) -> DataFrame:
    """CSV with a header row. ``schema=None`` falls back to inference (two passes)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


_LINE = "_rejected_line"


def checked_scan(spark: SparkSession, path: str, schema: T.StructType = HR_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """S1 with nothing lost unseen: ``(rows, rejected)``. ``rows`` are the lines whose every cell has its declared type.
    ``rejected(file, line, cells)`` holds the others as they stand in their file, with the names of the columns whose cell doesn't
    parse (none where only the number of cells is wrong). A file whose header differs from the schema raises.

    The lines are parsed once and written, as a scan of fewer columns would leave cells unparsed."""
    whole = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    parsed = (spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", _LINE).schema(whole).csv(path))
    parsed = temporary(parsed.select("*", F.col("_metadata.file_path").alias("_rejected_file")), "csv-lines")
    text = ", ".join(f"`{f.name}` string" for f in schema.fields)
    bad = parsed.where(F.col(_LINE).isNotNull()).withColumn("_cells", F.from_csv(_LINE, text))
    names = [F.when(F.col("_cells")[f.name].isNotNull() & F.col("`" + f.name + "`").isNull(), F.lit(f.name)) for f in schema.fields]
    rejected = bad.select(F.col("_rejected_file").alias("file"), F.col(_LINE).alias("line"),
                          F.array_compact(F.array(*names)).alias("cells"))
    return parsed.where(F.col(_LINE).isNull()).select(*["`" + f.name + "`" for f in schema.fields]), rejected


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one file per partition (no coalesce to one task)."""
    df.write.mode(mode).option("header", True).csv(path)
