"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightstream.llm import decontaminate, html_text, language, lines, lm, mixing, neighbours, oracles, prefix_trie, ranked, repeats, simhash, token_counts, token_files
from sightstream.llm.common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def over(function: Callable, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(*(table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": over(lambda d: token_files.op1(d, tokenizer_file()), "documents"),
        "op2_repeats": over(repeats.op2, "documents"),
        "op3_mixing": over(mixing.op3, "documents"),
        "op4_neighbours": over(neighbours.op4, "embeddings"),
        "op5_simhash": over(simhash.op5, "documents"),
        "op6_lm": over(lm.op6, "documents"),
        "op7_decontaminate": over(decontaminate.op7, "documents", "benchmark"),
        "op8_lines": over(lines.op8, "documents"),
        "op9_html_text": over(html_text.op9, "pages"),
        "op10_language": over(language.op10, "documents"),
        "op11_ranked": over(ranked.op11, "documents", "benchmark"),
        "op12_prefix_trie": over(prefix_trie.op12, "conversations"),
        "op13_token_counts": over(lambda d: token_counts.op13(d, tokenizer_file()), "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_repeats": oracles.OP2_SQL, "op7_decontaminate": oracles.OP7_SQL, "op3_mixing": mixing.OP3_SQL, "op4_neighbours": neighbours.OP4_SQL, "op8_lines": lines.OP8_SQL, "op11_ranked": ranked.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
