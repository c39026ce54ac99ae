"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm import chat, ctw, exact, frames, langid, minhash, packing, repeats, runs, tiling, tokens, toxic, trie
from shelf.llm.common import SPACE, fold, table, text_of
from shelf.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


@query("op1_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_exact_dedup", r"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
               FROM documents),
         g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op5_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op6_context_tree_weighting")
def context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score_texts(docs.withColumn("held_out", fold(docs, 7) == 2), "held_out")


@query("op7_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", fold(docs, 4) == 2)
    model = toxic.fit(toxic.labelled(docs.where("NOT held_out"), table(spark, sf_dir, "labels")))
    return toxic.score(docs, model, "doc_id", "held_out")


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold(docs, 5) == 0)
    model = langid.fit(docs.where("NOT held_out"))
    # the contract keeps 'und' for texts without a letter, so no cosine is too low
    return langid.predict(docs, model, "doc_id", "held_out", reject=0.0)


_STATED_TURNS = r"""
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'"""


@query("op10_chat_formatting", rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({_STATED_TURNS})),
         e AS (SELECT *, regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') AS safe,
                      lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same
               FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))
               AS loss_sha256,
           CAST(sum(length(safe) + 9 + CASE WHEN same THEN 0 ELSE 6 + length(regexp_replace(role, '([\\:])', '\\\1', 'g')) END)
                AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[
            F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                     F.lit(r"\### Assistant: </turn> ok").alias("text"))
            for i, role in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(stated)
    out = chat.format_chat(turns)
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op11_token_frames")
def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "frames")
    frames.write_tokens(table(spark, sf_dir, "documents"), folder)
    return frames.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_with_periods(table(spark, sf_dir, "documents")))
    # the longest run; of equals the first by start and period
    best = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), "
                  "(b, r) -> if(b is null or r.length > b.length, r, b))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The stated texts: a tenth of the documents, by the hash of their id, repeats a
    stretch of its words from a word on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", text_of().alias("text"), h.alias("h"))
    words = some.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(f"filter(split(text, r'{SPACE}'), w -> w != '')")))
    parts = words.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr("""concat_ws(' ', slice(words, 1, int(a)), slice(
        flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a)))""")
    return parts.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


# crc32 of a string by its definition, for h of each conversation
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]),
                             lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""


@query("op13_prefix_trie", f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
         o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(sha256(strlen(role) || ':' || role || text))) AS i
               FROM t),
         c AS (SELECT conv_id, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
         s AS (SELECT c.conv_id, i AS p, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND i <= h
               UNION ALL SELECT c.conv_id, i + 1000000000, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
         d AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS len,
                      sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ) OVER w) AS key
               FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
         m AS (SELECT conv_id, depth, key, len FROM d UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
         last AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY 1),
         ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN last USING (conv_id, depth) GROUP BY 1),
         n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS saved FROM m GROUP BY 1, 2),
         up AS (SELECT n.depth, n.key, p.key AS parent_key FROM n JOIN m p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
         kids AS (SELECT parent_key AS key, count(*) AS n_children FROM up GROUP BY 1),
         sub AS (SELECT a.key, sum(n.saved) AS saved, count(*) FILTER (kids.key IS NULL) AS leaves
                 FROM n JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.key = n.key GROUP BY 1)
    SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
           leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN sub USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key)
         LEFT JOIN up ON up.key = n.key LEFT JOIN n q ON q.key = up.parent_key""")
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.sequences(table(spark, sf_dir, "conversations"))
    rebuilt = trie.with_shared_head(
        own, F.expr("conv_id - conv_id % 100"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)
    nodes, members = trie.prefix_trie(rebuilt)
    return nodes.join(trie.ends_digests(members), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
