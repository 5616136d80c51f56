"""The registered queries of this subpackage: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .decontaminate import find_leaks
from .fill_in_middle import fill_in_middle, restored
from .fingerprints import compare_versions
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .language_id import held_out, identify, learn_prototypes
from .line_dedup import dedup_lines
from .merkle import document_manifest
from .packing import pack_documents
from .piece_encoding import decode_pieces, encode_pieces
from .suffix_dedup import repeated_passages
from .token_files import read_token_files, write_token_files
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes).drop("text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(_table(spark, sf_dir, "pages"))).drop("file", "offset")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(_table(spark, sf_dir, "documents")).drop("differing_edited")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(shards)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    counted = encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)})
    return decode_pieces(counted, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_language": op2_language,
        "op3_warc": op3_warc,
        "op4_repeated_passages": op4_repeated_passages,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_token_files": op8_token_files,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def _crc32_sql() -> str:
    """A table function-free CRC-32 (polynomial 0xEDB88320, bit by bit) of the decimal doc_id in SQL."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "xor(c, ascii(x))"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    return f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: {byte.replace('ascii(x)', 'x')}, 4294967295::BIGINT), 4294967295)"


def _manifest_sql() -> str:
    """Trees by recursion over levels, the siblings of every node by a self-join, and the way up folded over a list of them."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    grown = "sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 15) // 16)"
    side = lambda sign: f"coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx {sign} a.idx), '')"
    return f"""
            WITH RECURSIVE d AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf,
                CASE WHEN {_crc32_sql()} % 5 = 0 THEN sha256({head} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS claim FROM documents),
            l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
            s AS (SELECT source, 0 AS lvl, idx, leaf AS digest, n FROM l UNION ALL SELECT source, lvl + 1, idx // 16, {grown} FROM s WHERE n > 1 GROUP BY source, lvl, idx // 16),
            g AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM s WHERE n = 1),
            u AS (SELECT 0 AS lvl, idx, subroot AS digest, n FROM g UNION ALL SELECT lvl + 1, idx // 16, {grown} FROM u WHERE n > 1 GROUP BY lvl, idx // 16),
            x AS (SELECT a.source, a.lvl, a.idx, {side('<')} AS lefts, {side('>')} AS rights FROM s a JOIN s b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 16 = b.idx // 16
                WHERE a.n > 1 GROUP BY ALL),
            y AS (SELECT a.lvl, a.idx, {side('<')} AS lefts, {side('>')} AS rights FROM u a JOIN u b ON a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL),
            p AS (SELECT l.doc_id, l.leaf, 0 AS tree, x.lvl, lefts, rights FROM l JOIN x ON x.source IS NOT DISTINCT FROM l.source AND x.idx = l.idx // (16 ** x.lvl)::BIGINT
                UNION ALL SELECT l.doc_id, l.leaf, 1, y.lvl, lefts, rights FROM l JOIN g ON g.source IS NOT DISTINCT FROM l.source JOIN y ON y.idx = g.idx // (16 ** y.lvl)::BIGINT),
            w AS (SELECT doc_id, leaf, list({{'l': lefts, 'r': rights}} ORDER BY tree, lvl) AS path FROM p GROUP BY ALL),
            f AS (SELECT l.doc_id, l.leaf, g.subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda z: z.l || z.r), '')) AS proof_sha256,
                list_reduce(list_transform(coalesce(path, []), lambda z: {{'l': z.l, 'r': z.r, 'h': ''}}), lambda a, z: {{'l': '', 'r': '', 'h': sha256(z.l || a.h || z.r)}}, {{'l': '', 'r': '', 'h': coalesce(claim, l.leaf)}}).h AS folded_root
                FROM l JOIN g ON g.source IS NOT DISTINCT FROM l.source LEFT JOIN w ON w.doc_id = l.doc_id AND w.leaf = l.leaf)
            SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the tests hold the others against brute force."""
    return {
        "op3_warc": """
            WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
            f AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
            SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
                CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
            FROM p LEFT JOIN f USING (html)""",
        "op9_line_dedup": r"""
            WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            s AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^ \x09-\x0D]')) AS solid FROM l),
            c AS (SELECT doc_id, solid[k] AS first, solid[k + 1] AS last, array_to_string(lines[solid[k] : solid[k + 1]], chr(10)) AS chunk
                FROM (SELECT *, unnest(range(1, len(solid))) AS k FROM s)),
            r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS place FROM c),
            g AS (SELECT doc_id, list_distinct(flatten(list(range(first, last + 1)))) AS gone FROM r WHERE place > 1 GROUP BY doc_id),
            j AS (SELECT l.doc_id, lines, gone, list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)) AS stays FROM l JOIN g USING (doc_id)),
            k AS (SELECT *, list_transform(stays, lambda i: lines[i]) AS left_lines FROM j),
            t AS (SELECT *, len(list_filter(left_lines, lambda x: regexp_matches(x, '[^ \x09-\x0D]'))) > 0 AS solid FROM k)
            SELECT d.* REPLACE (CASE WHEN t.doc_id IS NULL THEN d.text WHEN t.solid THEN array_to_string(t.left_lines, chr(10)) ELSE '' END AS text),
                CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INTEGER AS n_lines,
                CASE WHEN t.doc_id IS NULL THEN 0 WHEN t.solid THEN len(t.gone) ELSE len(t.lines) END::INTEGER AS n_removed
            FROM documents d LEFT JOIN t USING (doc_id)""",
        "op7_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS i FROM w WHERE len(words) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
            e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
            r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
        "op12_merkle_manifest": _manifest_sql(),
        "op13_fill_in_middle": r"""
            WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
            k AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
            p AS (SELECT *, array_to_string(units[1 : low], '') AS prefix, array_to_string(units[low + 1 : high], '') AS middle, array_to_string(units[high + 1 :], '') AS suffix FROM c)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
                sha256(text) AS restored_sha256 FROM p""",
    }
