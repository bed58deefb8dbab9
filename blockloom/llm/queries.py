"""Queries of this subpackage, by name, and the SQL that gives the same rows."""

from .bpe import op10_bpe
from .html_text import op2_html_text
from .imatch import op6_imatch
from .mixing import OP4_SQL, op4_mixing
from .neighbours import OP5_SQL, op5_neighbours
from .ngram_join import OP1_SQL, op1_ngram_join
from .tokencounts import op9_token_counts
from .tokenfiles import op8_tokenfiles
from .toxicity import op3_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_neighbours": op5_neighbours,
    "op6_imatch": op6_imatch,
    "op7_warc": op7_warc,
    "op8_tokenfiles": op8_tokenfiles,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL = {
    "op1_ngram_join": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op5_neighbours": OP5_SQL,
    "op7_warc": OP7_SQL,
}
