"""Unigram vocabularies: pieces and scores read from a public SentencePiece file."""

from __future__ import annotations


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in the order of the ids, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())], model.unk_id()
