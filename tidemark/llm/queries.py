"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from tidemark.llm.decontaminate import op7_decontaminate
from tidemark.llm.exact_dedup import op5_exact_dedup
from tidemark.llm.html_text import op6_html
from tidemark.llm.oracles import ORACLES
from tidemark.llm.packing import op3_packing
from tidemark.llm.pii import op4_pii
from tidemark.llm.quality import op8_quality
from tidemark.llm.resample import op12_resample
from tidemark.llm.secrets import op10_secrets
from tidemark.llm.sharding import op9_rendezvous
from tidemark.llm.simhash import op1_simhash
from tidemark.llm.toxicity import op11_toxicity
from tidemark.llm.trie import op13_trie
from tidemark.llm.warc import op2_warc

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html": op6_html,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_rendezvous": op9_rendezvous,
    "op10_secrets": op10_secrets,
    "op11_toxicity": op11_toxicity,
    "op12_resample": op12_resample,
    "op13_trie": op13_trie,
}
