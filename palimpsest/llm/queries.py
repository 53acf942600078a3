"""The queries of this subpackage, and the SQL of those that SQL can express."""

from palimpsest.llm.byte_bpe import op10_byte_bpe
from palimpsest.llm.chat_format import op2_chat_format
from palimpsest.llm.decontaminate import op6_decontaminate
from palimpsest.llm.embedding_dup import op9_embedding_dedup
from palimpsest.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from palimpsest.llm.html_text import op4_html_text
from palimpsest.llm.lexical_search import OP13_SQL, op13_lexical_search
from palimpsest.llm.line_dedup import OP5_SQL, op5_line_dedup
from palimpsest.llm.near_dup import op3_minhash_dedup
from palimpsest.llm.oracles import OP2_SQL, OP3_SQL, OP4_SQL, OP7_SQL, OP9_SQL
from palimpsest.llm.pii import OP12_SQL, op12_pii
from palimpsest.llm.quality import op1_quality
from palimpsest.llm.substring_dedup import op7_substring_dedup
from palimpsest.llm.token_file import op8_token_file

QUERIES = {
    "op1_quality": op1_quality,
    "op2_chat_format": op2_chat_format,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_html_text": op4_html_text,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_file": op8_token_file,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pii": op12_pii,
    "op13_lexical_search": op13_lexical_search,
}

SQL = {
    "op2_chat_format": OP2_SQL,
    "op3_minhash_dedup": OP3_SQL,
    "op4_html_text": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_pii": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
