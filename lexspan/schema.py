"""Column names and types of the tables."""

from pyspark.sql import types as T

TEXT_EN = "unofficial_text_en"
TEXT_FR = "unofficial_text_fr"
TEXTS = (TEXT_EN, TEXT_FR)
CHUNK_TEXT = "unofficial_text"
CHUNK_IDX = "chunk_idx"

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("citation_en", T.StringType()),
        T.StructField("citation2_en", T.StringType()),
        T.StructField("name_en", T.StringType()),
        T.StructField("document_date_en", T.TimestampType()),
        T.StructField("url_en", T.StringType()),
        T.StructField("scraped_timestamp_en", T.TimestampType()),
        T.StructField("unofficial_text_en", T.StringType()),
        T.StructField("citation_fr", T.StringType()),
        T.StructField("citation2_fr", T.StringType()),
        T.StructField("name_fr", T.StringType()),
        T.StructField("document_date_fr", T.TimestampType()),
        T.StructField("url_fr", T.StringType()),
        T.StructField("scraped_timestamp_fr", T.TimestampType()),
        T.StructField("unofficial_text_fr", T.StringType()),
        T.StructField("upstream_license", T.StringType()),
    ]
)

# Columns that identify a skipped document in the audit table.
AUDIT_COLUMNS = (
    "citation_en",
    "name_en",
    "document_date_en",
    "citation_fr",
    "name_fr",
    "document_date_fr",
)
