"""The registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from . import op01_wavelet, op02_packing, op03_lines, op04_media, op05_language, op06_pieces, op07_chat, op08_warc, op09_topk, op10_simhash, op11_fim, op12_minhash, op13_merkle

QUERIES = {
    "op1_wavelet": op01_wavelet.op1_wavelet,
    "op2_packing": op02_packing.op2_packing,
    "op3_line_dedup": op03_lines.op3_line_dedup,
    "op4_media": op04_media.op4_media,
    "op5_language": op05_language.op5_language,
    "op6_pieces": op06_pieces.op6_pieces,
    "op7_chat": op07_chat.op7_chat,
    "op8_warc": op08_warc.op8_warc,
    "op9_topk": op09_topk.op9_topk,
    "op10_simhash": op10_simhash.op10_simhash,
    "op11_fim": op11_fim.op11_fim,
    "op12_minhash": op12_minhash.op12_minhash,
    "op13_merkle": op13_merkle.op13_merkle,
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": op03_lines.ORACLE,
    "op7_chat": op07_chat.ORACLE,
    "op8_warc": op08_warc.ORACLE,
    "op9_topk": op09_topk.ORACLE,
    "op11_fim": op11_fim.ORACLE,
    "op12_minhash": op12_minhash.ORACLE,
    "op13_merkle": op13_merkle.ORACLE,
}
