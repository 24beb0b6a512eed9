"""Queries that write with the sinks and read with the readers, against SQL on the tables written."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import file_hash
from ..operators import annotation as A
from ..operators import treebank as S
from ..session import shared_dir, table
from ..sources import readers, sinks
from . import sqltext as Q
from .registry import query
from .treebank_queries import _lines, gold_tokens


def _scratch(spark, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def _local(path: str) -> str:
    """A path of the driver's own file system; files of a run (JSON, manifests) are written there."""
    return path.removeprefix("file://").removeprefix("file:")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) + 1)::BIGINT AS record FROM documents")
def s1_numbered_records(spark, sf):
    """Records numbered from 2 in the order of their file."""
    path = _scratch(spark, "records")
    table(spark, sf, "documents").select("doc_id").orderBy("doc_id").coalesce(1).write.parquet(path)
    return readers.number_records(spark.read.parquet(path))


@query(f"""WITH l AS (SELECT coalesce(source, 'none') AS source, doc_id, unnest({Q.lines('text')}) AS line, generate_subscripts({Q.lines('text')}, 1) AS i FROM documents WHERE text IS NOT NULL),
    s AS (SELECT source, doc_id, i, {Q.strip('line')} AS line FROM l)
    SELECT source, string_agg(line, chr(10) ORDER BY doc_id, i) AS text FROM s WHERE line <> '' GROUP BY source""")
def s2_documents(spark, sf):
    """The texts of each source as one plain text file, read as one document."""
    path = _scratch(spark, "plain")
    d = table(spark, sf, "documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", "text")
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(path)
    return readers.read_document(spark, path).select(F.regexp_extract("file", "source=([^/]*)/", 1).alias("source"), "text")


@query(f"""WITH {Q.TOKENS}, b AS (SELECT string_agg(form, ' ' ORDER BY id) AS text FROM gold GROUP BY doc, sent),
    d AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)
    SELECT text, count(*) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM d) WHERE text <> '' GROUP BY text""")
def s6_exclusions(spark, sf):
    """A treebank and plain lines to protect, each as files of its kind."""
    path = _scratch(spark, "exclude")
    sinks.write_conllu(_lines(gold_tokens(spark, sf)), f"{path}/bank.conllu", ["doc", "sent"])
    table(spark, sf, "documents").where("text is not null").select("text").write.text(f"{path}/lines.txt")
    return readers.read_exclusions(spark, f"{path}/*").groupBy("text").agg(F.count("*").alias("n"))


def _archives(spark, sf):
    """Interview archives: the utterances of up to 500 rows in each, one document for each row."""
    forms = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    rows = table(spark, sf, "sentences").where("text is not null").select((F.col("row_id") / 500).cast("bigint").alias("archive"), "row_id", forms.alias("words"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for i, words in zip(rows.row_id, rows.words):
                w = "".join(f"<w>{x[:1]}<hi>{x[1:]}</hi></w>" for x in words)
                seg = f'<seg type="utterance" xml:id="u{i}">{w}</seg><seg type="note"><w>no</w></seg>'
                z.writestr(f"r{i}_tei.xml", f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><annotationBlock who="S{i % 3}"><u>{seg}</u><spanGrp><span><w>no</w></span></spanGrp></annotationBlock></TEI>')
            z.writestr("readme.xml", "<x/>")
        return pd.DataFrame({"content": [raw.getvalue()]})

    return rows.groupBy("archive").applyInPandas(pack, "content binary")


@query(r"""SELECT 'r' || row_id || '_tei.xml' AS member FROM sentences WHERE text IS NOT NULL""")
def s7_archive_members(spark, sf):
    """The documents of the archives; other files are passed over."""
    return readers.archive_members(_archives(spark, sf)).select("member")


_UTTERANCES = r"""WITH s AS (SELECT row_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS w FROM sentences WHERE text IS NOT NULL)
    SELECT array_to_string(w, ' ') AS text, 'r' || row_id AS recording, 'u' || row_id AS utterance_id, 'S' || (row_id % 3) AS speaker, 'r' || row_id || '_tei.xml' AS member FROM s WHERE len(w) > 0"""


@query(_UTTERANCES)
def s8_utterances(spark, sf):
    return readers.archive_utterances(_archives(spark, sf))


@query(_UTTERANCES)
def x3_utterances(spark, sf):
    """The same by a table function, joined laterally to the archives' files."""
    readers.register(spark)
    members = readers.archive_members(_archives(spark, sf))
    return spark.sql("SELECT u.* FROM {m} AS m, LATERAL tei_utterances(m.content, m.member) AS u", m=members)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s12_json(spark, sf):
    """Counts written as one JSON file and read again."""
    n = [r.asDict() for r in table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()]  # a few languages
    path = _local(_scratch(spark, "counts")) + ".json"
    sinks.write_json(path, n)
    with open(path, encoding="utf-8") as f:
        rows = [(r["lang"], r["n"]) for r in json.load(f)]
    return spark.createDataFrame(rows, "lang string, n bigint")


@query(f"WITH {Q.TOKENS} SELECT sent, id, form, lemma, upos, feats, head, deprel FROM gold")
def s13_treebank_files(spark, sf):
    """Sentences written as treebank files and read again."""
    path = _scratch(spark, "bank") + ".conllu"
    sinks.write_conllu(_lines(gold_tokens(spark, sf)), path, ["doc", "sent"])
    s = readers.read_conllu(spark, path).withColumn("sent", S.metadata(F.col("lines"))["sent_id"].cast("bigint"))
    return S.word_table(s, ["sent"]).select("sent", "id", "form", "lemma", "upos", "feats", "head", "deprel")


@query(f"WITH {Q.TOKENS} SELECT sent, count(*) AS n_words FROM gold GROUP BY sent")
def x5_treebank_source(spark, sf):
    """The same files through the data source, file by file."""
    path = _scratch(spark, "bank")
    sinks.write_conllu(_lines(gold_tokens(spark, sf)), path, ["doc", "sent"])
    readers.register(spark)
    s = spark.read.format("treebank").option("pattern", "part-*").load(_local(path))
    n = F.size(S.words(F.col("lines"))).cast("bigint")
    return s.select(S.metadata(F.col("lines"))["sent_id"].cast("bigint").alias("sent"), n.alias("n_words"))


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def s15_event_log(spark, sf):
    """Events appended twice to a log, read back."""
    path = _scratch(spark, "log")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    for _ in range(2):
        sinks.append_events(e, path)
    return readers.read_jsonl(spark, path, e.schema).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, length(text) AS n FROM documents")
def s16_verified_load(spark, sf):
    """Documents written with a manifest and loaded after its hashes agree."""
    path = _scratch(spark, "prepared")
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    sinks.write_jsonl(d, f"{path}/documents")
    folder = _local(path)
    parts = [f"documents/{x}" for x in sorted(os.listdir(f"{folder}/documents")) if x.startswith("part-")]
    sinks.write_manifest(folder, parts, seed=42)
    return sinks.load_verified(spark, folder, "documents", d.schema).select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))


@query("SELECT count(*) AS n, true AS refused FROM documents")
def s17_immutable_output(spark, sf):
    """A second write to the same place is refused, and the first stays."""
    path = _scratch(spark, "once")
    d = table(spark, sf, "documents").select("doc_id")
    sinks.write_jsonl(d, path)
    try:
        sinks.write_jsonl(d, path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.schema("doc_id bigint").json(path).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


def _reviewed_files(spark, sf):
    """A model's and the analyzers' files of one batch; the second lacks some translations and differs in some forms."""
    s = _lines(gold_tokens(spark, sf)).select(F.col("sent").alias("pos"), "lines")
    english = F.array(F.lit("# text_en = a sentence"))
    model = s.select("pos", F.concat(english, "lines").alias("lines"))
    other = F.transform("lines", lambda x: F.when((F.col("pos") % 7 == 0) & ~x.startswith("#"), F.regexp_replace(x, r"^(\d+)\t", "$1\tx")).otherwise(x))
    return model, s.select("pos", F.concat(F.when(F.col("pos") % 5 != 0, english).otherwise(F.array().cast("array<string>")), other).alias("lines"))


@query(f"""WITH {Q.TOKENS}, s AS (SELECT DISTINCT sent FROM gold)
    SELECT 'analyzers' AS file, sent::VARCHAR AS sent_id, 'no_translation' AS problem FROM s WHERE sent % 5 = 0
    UNION ALL SELECT 'both', sent::VARCHAR, 'files_differ' FROM s WHERE sent % 5 = 0 OR sent % 7 = 0""")
def s18_publication_checks(spark, sf):
    """What stands against publishing the two files."""
    return A.publication_violations(*_reviewed_files(spark, sf))


@query("SELECT name, true AS same FROM (VALUES ('a.json'), ('b.json')) t(name)")
def s18_published_files(spark, sf):
    """Files copied after their recorded hashes agree, and compared with the originals."""
    folder = _local(_scratch(spark, "review"))
    os.makedirs(folder)
    counts = {r["lang"] or "": r["n"] for r in table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a few languages
    files = {name: f"{folder}/{name}" for name in ("a.json", "b.json")}
    for path in files.values():
        sinks.write_json(path, counts)
    manifest = sinks.write_manifest(folder, list(files))
    done = sinks.publish(files, f"{folder}-out", manifest["files"])
    return spark.createDataFrame([(n, file_hash(f"{folder}-out/{n}") == h) for n, h in done.items()], "name string, same boolean")


@query("SELECT 'changed' AS step, true AS ok UNION ALL SELECT 'refused', true UNION ALL SELECT 'backed up', true")
def s19_staged_apply(spark, sf):
    """A file replaced after its hash agrees; a stale one is refused and stays."""
    folder = _local(_scratch(spark, "apply"))
    os.makedirs(folder)
    path = f"{folder}/rows.json"
    sinks.write_json(path, {"n": table(spark, sf, "documents").count()})
    before = file_hash(path)
    sinks.staged_apply({path: (before, b"new")}, f"{folder}/backup")
    try:
        sinks.staged_apply({path: (before, b"newer")}, f"{folder}/backup2")
        refused = False
    except ValueError:
        refused = True
    with open(path, "rb") as f:
        changed = f.read() == b"new"
    saved = [file_hash(f"{folder}/backup/{x}") for x in os.listdir(f"{folder}/backup")]
    return spark.createDataFrame([("changed", changed), ("refused", refused), ("backed up", saved == [before])], "step string, ok boolean")


@query("""SELECT mix, language, CASE WHEN weight > 0 AND weight <= 1 AND max_repeats >= 1 THEN true ELSE false END AS valid FROM mix_targets""")
def c26_valid_options(spark, sf):
    """Each target of a mix as the options of a run."""
    rows = table(spark, sf, "mix_targets").select("mix", "language", "weight", "max_repeats").collect()  # a few targets

    def valid(r) -> bool:
        try:
            config.validate({"mask_probability": r["weight"], "count": r["max_repeats"]})
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(r["mix"], r["language"], valid(r)) for r in rows], "mix string, language string, valid boolean")


@query("SELECT unnest(['cores', 'platform', 'pyspark', 'python', 'spark', 'time']) AS name, true AS known")
def c27_environment(spark, sf):
    found = config.environment(spark)
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "name string, known boolean")


@query("SELECT true AS utc, true AS not_before")
def f21_utc_time(spark, sf):
    """A time stamp is in UTC and not before the latest one taken earlier."""
    first, second = config.utc_now(), config.utc_now()
    return spark.createDataFrame([(second.endswith("+00:00"), first <= second)], "utc boolean, not_before boolean")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def f2_file_hashes(spark, sf):
    """Hashes of files' bytes, one file for each text: written, listed and hashed natively."""
    from ..functions.hashing import file_hashes

    d = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return file_hashes(d, ["doc_id"])


