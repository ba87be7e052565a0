"""The queries of this folder and the SQL of those that it can express. The others need hashes, models or algorithms
that DuckDB lacks, or take far too long there on whole tables; tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlight.llm.collocations import OP12_SQL, op12_collocations
from orderlight.llm.divergence import OP11_SQL, op11_divergence
from orderlight.llm.fingerprints import op1_fingerprints
from orderlight.llm.licenses import op9_licenses
from orderlight.llm.mixing import op2_mixing
from orderlight.llm.multiindex import op4_multiindex
from orderlight.llm.packing import op6_packing
from orderlight.llm.pfor import op8_tokens
from orderlight.llm.quality import OP13_SQL, op13_quality
from orderlight.llm.secrets import op10_secrets
from orderlight.llm.simhash import op7_simhash
from orderlight.llm.suffixes import op5_suffixes
from orderlight.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_mixing, op3_toxicity, op4_multiindex, op5_suffixes, op6_packing, op7_simhash, op8_tokens, op9_licenses, op10_secrets,
        op11_divergence, op12_collocations, op13_quality,
    )
}

ORACLES: dict[str, str] = {"op11_divergence": OP11_SQL, "op12_collocations": OP12_SQL, "op13_quality": OP13_SQL}
