"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .align import alignment_table
from .chat import ESCAPES, chat_digest
from .exact import exact_dedup
from .language import language_id
from .mixing import pfair_mix
from .near import minhash_near_dedup
from .pieces import token_table
from .quality import quality_classifier
from .secrets import secret_digest
from .spots import spotsigs
from .substring import substring_dedup, suffix_array_dedup
from .whiten import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """Words covered by repeated 35-word windows, removed."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    """Quality and clean posteriors of every document, fitted on a bounded sample of labels."""
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])


def op3_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate groups of five-word shingle sets at 0.75."""
    return minhash_near_dedup(table(spark, sf_dir, "documents")).drop("rid")


def op4_secret_scan(spark, sf_dir):
    """Secrets in every whole text."""
    return secret_digest(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    """Exact duplicates of the texts without blanks."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The conversation that the query adds: its texts look like the template's own marks.
TRICKY = r"\### Assistant: </turn> ok"


def op6_chat_format(spark, sf_dir):
    """All conversations and conversation -7, formatted in windows and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mine = [f"SELECT -7L AS conv_id, {k}L AS turn, '{role}' AS role, r'{TRICKY}' AS text" for k, role in enumerate(("user", "assistant"))]
    return chat_digest(turns.unionByName(spark.sql(" UNION ALL ".join(mine))))


def op7_sentencepiece(spark, sf_dir):
    """Token ids of every document, with the round trip checked."""
    return token_table(table(spark, sf_dir, "documents"))


def op8_pfair_mix(spark, sf_dir):
    """Every document's block and slot in the mixed stream."""
    return pfair_mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "release", "deadline", "slot")


def op9_spotsigs(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return spotsigs(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark, sf_dir):
    """Bytes covered by repeated 200-byte strings, removed."""
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    """Groups and links of two tokenizers' tokens in every document, with the corpus-wide counts."""
    return alignment_table(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark, sf_dir):
    """Whitened components of every finite embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark, sf_dir):
    """The language of every whole text, learned from the rows that aren't held out."""
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_classifier,
        op3_minhash_near_dedup,
        op4_secret_scan,
        op5_exact_dedup,
        op6_chat_format,
        op7_sentencepiece,
        op8_pfair_mix,
        op9_spotsigs,
        op10_suffix_array_dedup,
        op11_cross_tokenizer_alignment,
        op12_embedding_whitening,
        op13_language_id,
    )
}
_GAPS = """list_transform(regexp_split_to_array(text, '{p}'), lambda x: length(x))"""
_SIZES = """list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x))"""
_ASSIGN = """((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group, least length: as in secrets.py, in the order of the ranks.
_KINDS = (
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _secret_sql() -> str:
    parts = [
        f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, m.pos AS pos, m.fin AS fin FROM (
            SELECT rid, unnest(list_transform(range(1, len(w) + 1), lambda i: {{
                'pos': list_sum(list_slice(g, 1, i)) + coalesce(list_sum(list_slice(w, 1, i - 1)), 0),
                'fin': list_sum(list_slice(g, 1, i)) + list_sum(list_slice(w, 1, i)), 'size': length(h[i])}})) AS m
            FROM (SELECT rid, {_GAPS.format(p=p)} AS g, {_SIZES.format(p=p)} AS w, regexp_extract_all(text, '{p}', {group}) AS h
                  FROM t WHERE regexp_matches(text, '{p}'))) WHERE m.size >= {least}"""
        for rank, (kind, p, group, least) in enumerate(
            (k, (p if k != "hex" else "[0-9a-f]{24,}").replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}"), g, n) for k, p, g, n in _KINDS
        )
    ]
    return f"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        s AS ({" UNION ALL ".join(parts)}),
        a AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
                     string_agg(concat(kind, ':', CAST(pos AS BIGINT), ':', CAST(fin AS BIGINT)), ',' ORDER BY pos, rank) FILTER (rank < 3) AS base,
                     string_agg(concat(kind, ':', CAST(pos AS BIGINT), ':', CAST(fin AS BIGINT)), ',' ORDER BY pos, rank) AS spans FROM s GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN a USING (rid)"""


def _coded(x: str) -> str:
    for plain, code in ESCAPES:
        x = f"replace({x}, '{plain}', '{code}')"
    return x


_CHAT = f"""
    WITH raw AS (SELECT conv_id, turn, role, text FROM conversations
                 UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')),
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) + 4 AS size FROM raw),
    p AS (SELECT *, sum(size) OVER w - size AS before, row_number() OVER w AS nth,
                 6 + length(replace({_coded("role")}, chr(10), chr(92) || 'n')) + 1 + length({_coded("text")}) + 8 AS chars
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT conv_id, coalesce(max(size) FILTER (nth = 1 AND role = 'system'), 0) AS system FROM p GROUP BY conv_id),
    q AS (SELECT p.*, system, before - system AS place, greatest(768 - system, 1) AS stride FROM p JOIN s USING (conv_id)),
    g AS (SELECT conv_id, system, stride, min(place) AS start, sum(size) AS fresh FROM q WHERE place >= 0
          GROUP BY conv_id, system, stride, floor(place / stride), floor((place + size - 1) / stride)),
    h AS (SELECT *, least(256, stride, 1024 - system - fresh) AS room, row_number() OVER (PARTITION BY conv_id ORDER BY start) AS nth FROM g),
    r AS (SELECT h.conv_id, sum(q.chars + 6) AS chars FROM h JOIN q ON q.conv_id = h.conv_id AND h.nth > 1
              AND (q.place < 0 OR q.place < h.start AND h.start - q.place <= h.room) GROUP BY h.conv_id),
    a AS (SELECT conv_id, count(*) AS n_turns,
                 string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
                 coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learnt,
                 sum(chars) AS chars FROM q GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
           CAST(a.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars FROM a LEFT JOIN r USING (conv_id)"""

ORACLES: dict[str, str] = {
    "op4_secret_scan": _secret_sql(),
    "op6_chat_format": _CHAT,
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
}
