"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendspan.llm.bpe import op10_bpe
from trendspan.llm.chat import OP6_SQL, op6_chat
from trendspan.llm.curves import op9_curves
from trendspan.llm.decontamination import op4_decontamination
from trendspan.llm.html_text import op8_html_text
from trendspan.llm.line_dedup import OP3_SQL, op3_line_dedup
from trendspan.llm.middle import OP13_SQL, op13_middle
from trendspan.llm.packing import op12_packing
from trendspan.llm.passages import op5_passages
from trendspan.llm.periodic_runs import op11_periodic_runs
from trendspan.llm.simhash import op7_simhash
from trendspan.llm.token_stream import op1_token_files
from trendspan.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_passages": op5_passages,
    "op6_chat": op6_chat,
    "op7_simhash": op7_simhash,
    "op8_html_text": op8_html_text,
    "op9_curves": op9_curves,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_middle": op13_middle,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op6_chat": OP6_SQL,
    "op13_middle": OP13_SQL,
}
