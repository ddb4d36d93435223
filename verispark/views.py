"""Tables of the domain derived from the given parquet tables.

Each view is one projection written in SQL both Spark and DuckDB read, so the query and its
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Tables of long texts: their work per byte is high.
TEXT_TABLES = {"documents", "pages", "conversations"}

# A file of one row group is one task. Whoever runs such small files on many cores (the bench does) can name a number of
# partitions; nothing is dealt anew unless this is set, whatever the size.
SCAN_PARTITIONS = "spark.verispark.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted and name in TEXT_TABLES else df


# name -> (base table, projection)
VIEWS: dict[str, tuple[str, str]] = {
    "v_claims": (
        "benchmark",
        """CAST(item_id AS BIGINT) AS id, 'am_benchmark' AS source, CAST(item_id AS STRING) AS external_id,
  text AS claim_text, 'SUPPORTS' AS label, CAST(item_id % 4 AS STRING) AS label_original,
  CASE item_id % 5 WHEN 0 THEN 'R.13' WHEN 1 THEN 'M.39' WHEN 2 THEN 'M.XX' WHEN 3 THEN 'Matematyka' ELSE 'Fizyka' END AS topic,
  CASE WHEN item_id % 11 = 10 THEN 'n/a' ELSE CAST(2005 + item_id % 20 AS STRING) END AS claim_date,
  CASE WHEN item_id % 13 = 12 THEN '{bad' ELSE concat('{"answers": "[''A', CAST(item_id AS STRING), ''', ''B'', ''C'', ''D'']", "correct_answer_index": "', CAST(item_id % 4 AS STRING), '", "exam_type": "', CASE WHEN item_id % 2 = 0 THEN 'matura' ELSE 'zawodowy' END, '"}') END AS metadata""",
    ),
    "v_results": (
        "events",
        """event_id AS id, concat('uam_ga', CAST(user_id % 6 + 1 AS STRING), '__', CASE WHEN event_id % 2 = 0 THEN 'bielik-11b' ELSE 'llama3.1-8b' END) AS agent_name,
  CAST(floor(event_id / 47) AS BIGINT) AS claim_id, 'am_benchmark' AS benchmark_name,
  CAST(CAST(floor(event_id / 47) AS BIGINT) % 4 AS STRING) AS original_label,
  CASE WHEN event_id % 16 < 10 THEN CAST((event_id + user_id) % 4 AS STRING) WHEN event_id % 16 = 10 THEN 'ERROR' WHEN event_id % 16 = 11 THEN 'ERROR_MAX_STEPS' WHEN event_id % 16 = 12 THEN '1.0' WHEN event_id % 16 = 13 THEN '2.5' WHEN event_id % 16 = 14 THEN 'Output: 2'
    ELSE CASE user_id % 6 WHEN 0 THEN '[''x'', ''y'']' WHEN 1 THEN 'None' WHEN 2 THEN 'N/A' WHEN 3 THEN '-1' WHEN 4 THEN '' ELSE '7' END END AS model_label,
  CASE WHEN event_id % 16 < 10 AND (event_id + user_id) % 4 = CAST(floor(event_id / 47) AS BIGINT) % 4 THEN 1 ELSE 0 END AS is_correct,
  180 + event_id % 97 + user_id % 50 AS total_tokens, 180 + event_id % 97 AS prompt_tokens, user_id % 50 AS completion_tokens,
  value / 100 AS time_thought,
  CASE WHEN event_id % 16 = 11 THEN
    CASE user_id % 5
      WHEN 0 THEN concat('[{"role": "assistant", "content": "{\\"action\\": \\"final_answer\\", \\"action_input\\": {\\"label\\": \\"', CAST(user_id % 4 AS STRING), '\\"}}"}, {"role": "tool", "content": "Observation"}]')
      WHEN 1 THEN concat('[{"role": "assistant", "content": "broken {\\"label\\": \\"', CAST(user_id % 6 AS STRING), '\\""}, {"role": "user", "content": "again"}]')
      WHEN 2 THEN concat('[{"role": "assistant", "content": "{\\"action\\": \\"final_answer\\", \\"action_input\\": {\\"label\\": \\"1\\"}}"}, {"role": "assistant", "content": "{\\"action\\": \\"final_answer\\", \\"action_input\\": {\\"label\\": \\"', CAST(event_id % 4 AS STRING), '\\"}}"}]')
      WHEN 3 THEN '[{"role": "assistant", "content": "no answer here"}]'
      ELSE 'not json' END
    ELSE concat(event_type, ': ', props, ' at step ', CAST(event_id AS STRING)) END AS raw_output,
  CASE WHEN event_id % 2 = 0 THEN 'bielik-11b' ELSE 'llama3.1-8b' END AS model_name, ts AS created_at, event_type""",
    ),
    "v_articles": (
        "documents",
        """doc_id AS page_id, concat('Doc ', CAST(doc_id AS STRING)) AS title,
  replace(replace(text, concat('.', chr(10), 'T'), concat('.', chr(10), chr(10), chr(10), 'T')), concat('.', chr(10), 'O'), concat('.', chr(10), chr(10), 'O')) AS text, lang, source""",
    ),
    "v_turns": (
        "conversations",
        """conv_id AS claim_id, turn, role,
  CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN concat('<think>', text, '</think>', chr(10), '```json', chr(10), '{"action": "final_answer", "action_input": {"label": "', CAST(conv_id % 5 AS STRING), '"}}', chr(10), '```') ELSE text END AS content""",
    ),
    "v_votes": (
        "labels",
        """doc_id AS claim_id, style_no, CAST(CASE doc_id % 3 WHEN 0 THEN (doc_id + quality) % 3 WHEN 1 THEN (doc_id * style_no + quality) % 3 ELSE (doc_id + CASE WHEN style_no = 3 THEN 1 ELSE 0 END) % 3 END AS STRING) AS label,
  concat('wniosek ', CAST(doc_id AS STRING), ' toxic ', CAST(toxic AS STRING), CASE WHEN (doc_id + 1) % style_no = 0 THEN ' doc matematyka' ELSE '' END) AS reasoning""",
    ),
    "v_answers": (
        "conversations",
        """conv_id, turn, role, CASE (conv_id + turn) % 12
  WHEN 0 THEN concat(' ', CAST(turn % 6 AS STRING), ' ')
  WHEN 1 THEN concat('Odpowiedź: ', CAST(turn % 4 AS STRING), ' bo nie 3')
  WHEN 2 THEN concat('Wybieram 1 lub 2. ', text, ' 0')
  WHEN 3 THEN concat('```json', chr(10), '["a ', CAST(conv_id AS STRING), '", "b", ""]', chr(10), '```')
  WHEN 4 THEN concat('<think>', text, '{"label": "x"}</think> {"action": "final_answer", "action_input": {"label": "', CAST(turn AS STRING), '"}, "label": "PRAWDA"}')
  WHEN 5 THEN concat('Lista: ["x ', CAST(turn AS STRING), '", "z"] koniec')
  WHEN 6 THEN concat('To jest CZĘŚCIOWA_PRAWDA ', CAST(conv_id AS STRING))
  WHEN 7 THEN concat('odpowiedz: FAŁSZ, ', text)
  WHEN 8 THEN '{"label": "MANIPULACJA", "why": "x"}'
  WHEN 9 THEN concat('<THINK>a', chr(10), 'b</THINK><scratchpad>c</scratchpad>{"action": "search", "q": ', CAST(turn AS STRING), '}')
  WHEN 10 THEN concat(CAST(turn AS STRING), '.00')
  ELSE text END AS raw, text, 100 + turn * 10 + 7 AS total_tokens, 100 + turn * 10 AS prompt_tokens, 7 AS completion_tokens""",
    ),
    "v_exam": (
        "documents",
        """doc_id, CASE WHEN doc_id % 9 = 4 THEN concat(' ', chr(10), ' ') ELSE text END AS question,
  concat('[''A', CAST(doc_id AS STRING), ''', ''B'', ''C'', ''D'']') AS answers, CAST(doc_id % 4 AS STRING) AS correct_answer_index, source AS name,
  CASE WHEN doc_id % 11 = 5 THEN NULL ELSE CAST(2005 + doc_id % 20 AS STRING) END AS year, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS type""",
    ),
    "v_statements": (
        "documents",
        """doc_id AS id, CASE WHEN doc_id % 9 = 4 THEN '' ELSE text END AS statement, source AS person_name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('rola ', lang) END AS person_function,
  CASE doc_id % 5 WHEN 0 THEN concat(CAST(doc_id % 28 + 1 AS STRING), '.02.2026 godz.16:28') WHEN 1 THEN '25.12.2025' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'wczoraj' END AS publication_date,
  CASE doc_id % 9 WHEN 0 THEN 'Prawda' WHEN 1 THEN ' FAŁSZ ' WHEN 2 THEN 'Częściowa prawda' WHEN 3 THEN 'Częściowo prawda' WHEN 4 THEN 'Manipulacja' WHEN 5 THEN 'Nieweryfikowalne' WHEN 6 THEN 'brak danych' WHEN 7 THEN 'xyz' ELSE NULL END AS rating,
  concat('https://example.org/', CAST(doc_id AS STRING)) AS detail_url, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(lang, '|', source) END AS tag_text,
  CASE WHEN doc_id % 2 = 0 THEN concat('kategoria "', lang, '"') ELSE '' END AS category, CASE WHEN doc_id % 3 = 1 THEN '9 min czytania' END AS reading_time""",
    ),
    "v_debate": (
        "conversations",
        """conv_id AS claim_id, CAST(floor(turn / 2) AS INT) AS round_no, CASE WHEN turn % 2 = 0 THEN 'proponent' ELSE 'opponent' END AS role,
  CAST((conv_id + turn) % 3 AS STRING) AS label, text AS argument, (conv_id + turn) % 7 = 6 AS failed, 50 + turn AS total_tokens""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return project(table(spark, sf_dir, VIEWS[name][0]), name)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """The same table as a stream of files, whether it is one file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    is_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(str(path.toString())).schema).option("maxFilesPerTrigger", files_per_batch)
    # A stream source is a folder, so a table of one file is picked out of its own.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if is_file else reader.parquet(path.toString())


def project(df: DataFrame, name: str) -> DataFrame:
    """The projection of a view over its base table, batch or stream."""
    projection = VIEWS[name][1]
    if name == "v_votes":
        df = df.selectExpr("*", "explode(array(1, 2, 3)) AS style_no")
    # A Spark SQL string literal reads \\" as ", so the backslash is doubled for it.
    text = projection.replace(chr(92), chr(92) * 2).replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"SELECT {text} FROM {{base}}", base=df)


def duckdb_cte(name: str) -> str:
    base, projection = VIEWS[name]
    source = base
    if name == "v_votes":
        source = f"{base} CROSS JOIN (SELECT unnest([1, 2, 3]) AS style_no)"
    return f"{name} AS (SELECT {projection} FROM {source})"
