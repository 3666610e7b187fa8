"""A book catalogue derived from the documents table, by one statement that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOOKS_SQL = """
SELECT doc_id AS ord,
  CASE WHEN mod(doc_id, 4) = 0
       THEN split_part('活着|《活着》(珍藏版)|三体|三体 典藏版|平凡的世界|人生|围城|边城', '|',
                       1 + CAST(mod(ascii(substr(md5(text), 2, 1)), 8) AS INT))
       ELSE trim(substr(split_part(text, chr(10), 1), 1, 60)) END AS title,
  split_part('余华|余华 著|余秋雨|鲁迅|周树人|刘慈欣|路遥|路遥远|Jane Austen|J. Austen|Leo Tolstoy|Alexei Tolstoy|Victor Hugo|佚名||Thomas Mann', '|',
             1 + CAST(mod(ascii(substr(md5(text), 1, 1)) + ascii(substr(md5(text), 3, 1)), 16) AS INT)) AS author,
  CASE WHEN mod(doc_id, 2) = 0 THEN source ELSE '' END AS publisher,
  '' AS publish_date,
  CASE WHEN mod(doc_id, 3) = 0 THEN ''
       ELSE translate(substr(md5(text), 1, 10), 'abcdef', '012345') END AS isbn,
  lang AS language,
  '' AS description,
  concat('/lib/', source, '/', CAST(doc_id AS STRING), '.',
         split_part('epub|pdf|mobi|azw3|txt', '|', 1 + CAST(mod(doc_id, 5) AS INT))) AS file_path,
  split_part('epub|pdf|mobi|azw3|txt', '|', 1 + CAST(mod(doc_id, 5) AS INT)) AS file_format,
  n_chars AS file_size,
  substr(text, 1, 1000) AS lead_text,
  CASE WHEN mod(doc_id, 7) = 0 THEN concat('/covers/', CAST(doc_id AS STRING), '.jpg') ELSE '' END AS cover_path,
  CASE WHEN mod(doc_id, 6) = 0 THEN 'fiction,classic' ELSE '' END AS tag_text
FROM documents
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOOKS_SQL.replace("FROM documents", "FROM {documents}"), documents=read(spark, sf_dir, "documents"))


#: The catalogue with later editions of its books: names with a middle name in two spellings, and reprints of the same content under a longer title.
#: ``ord`` counts on after the books'; editions have no ISBN.
EDITIONS_SQL = """
SELECT ord, title, author, isbn, file_path, file_format, file_size, lead_text FROM books
UNION ALL SELECT ord + 1000000000, title, replace(author, ' ', ' Marie '), '', concat(file_path, '.2'), file_format, file_size, lead_text FROM books WHERE author LIKE '% %'
UNION ALL SELECT ord + 2000000000, title, replace(author, ' ', ' Maria '), '', concat(file_path, '.3'), file_format, file_size, lead_text FROM books WHERE author LIKE '% %'
UNION ALL SELECT ord + 3000000000, concat(title, ' II'), author, '', concat(file_path, '.4'), 'epub', file_size, lead_text FROM books WHERE author <> ''
"""


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books and their editions, with the fields that fingerprints need."""
    own = spark.sql(EDITIONS_SQL.replace("FROM books", "FROM {books}"), books=books(spark, sf_dir))
    return own.selectExpr("*", "'' AS publisher", "'' AS publish_date", "'' AS language", "'' AS description")
