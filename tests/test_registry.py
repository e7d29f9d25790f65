from pyspark.sql import functions as F

from chunkloom.functions import identifiers as I
from chunkloom.functions import text as T
from chunkloom.functions.registry import register
from chunkloom.functions.vectors import cosine_distance


def test_sql_functions_agree_with_columns(spark):
    assert len(register(spark, 8)) == 11
    rows = [("What's New? Ü_1", 5, 123456789), ("a/b/c.ts", 7, 5_000_000_000), ("tab\tx\x1b", 1, 12), ("", 2, 0), (None, None, None)]
    spark.createDataFrame(rows, "x string, n int, b long").createOrReplaceTempView("given")
    x, n = F.col("x"), F.col("n")
    pairs = {
        "cl_content_hash(x)": I.content_hash(x),
        "cl_file_id(x, 'c', 'b', x)": I.file_id(x, F.lit("c"), F.lit("b"), x),
        "cl_point_id(x, n)": I.point_id(x, n),
        "cl_git_blob_id(x)": I.git_blob_id(x),
        "cl_slug(x)": T.slug(x),
        "cl_sanitize(x)": T.sanitize(x),
        "cl_file_name(x)": T.file_name(x),
        "cl_format_bytes(b)": T.format_bytes(F.col("b")),
    }
    for sql, column in pairs.items():
        assert spark.sql(f"SELECT {sql} AS r FROM given").collect() == spark.table("given").select(column.alias("r")).collect(), sql


def test_table_and_vector_functions(spark):
    register(spark, 8)
    got = spark.sql("SELECT c.start_line, c.chunk_type FROM (SELECT 'export enum A { B }' AS t) s, LATERAL cl_cut_typescript(s.t, 'a.ts', 6000) c").collect()
    assert [tuple(r) for r in got] == [(1, "enum")]
    assert len(spark.sql("SELECT cl_embed_words('two words').vector AS v").head().v) == 8
    vectors = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([1.0],)], "v array<float>")
    vectors.createOrReplaceTempView("vectors")
    sql = [r[0] for r in spark.sql("SELECT cl_cosine_distance(v, array(2F, 1F)) FROM vectors").collect()]
    assert sql == [r[0] for r in vectors.select(cosine_distance(F.col("v"), [2.0, 1.0])).collect()]
