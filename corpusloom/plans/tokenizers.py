"""Checks that a tokenizer knows the tags of a corpus."""

from __future__ import annotations

from typing import Any

#: Fixed value: the sentence that the tags are tried in.
TRIAL = "Question: What is 2+2? {0} Let me think {1} Answer: 4"


def tag_report(tokenizer: Any, tags: tuple[str, str] = ("<ToW>", "</ToW>")) -> dict:
    """What `tokenizer` (get_vocab, tokenize; additional_special_tokens if it has them) knows of an opening and a closing tag.

    Valid where both stand in the vocabulary. A tag that doesn't is an issue; one that does, but doesn't come out whole of the trial
    sentence, is a warning. A tokenizer that fails altogether is reported as invalid, with the reason.
    """
    report = {"is_valid": False, "vocab_size": 0, "ids": dict.fromkeys(tags), "special": [], "issues": [], "warnings": []}
    try:
        vocab = tokenizer.get_vocab()
    except Exception as e:  # whatever the object raises
        return report | {"issues": [f"the vocabulary can't be read: {e}"]}
    extra = getattr(tokenizer, "additional_special_tokens", None) or []
    report |= {"vocab_size": len(vocab), "ids": {t: vocab.get(t) for t in tags}, "special": [t for t in tags if t in extra], "is_valid": all(t in vocab for t in tags)}
    report["issues"] = [f"{t} is missing from the vocabulary" for t in tags if t not in vocab]
    try:
        pieces = [str(p) for p in tokenizer.tokenize(TRIAL.format(*tags))]
    except Exception as e:  # as above
        report["issues"].append(f"the trial sentence can't be tokenized: {e}")
        return report
    report["warnings"] = [f"{t} is known but doesn't stay whole" for t in tags if t in vocab and not any(t in p for p in pieces)]
    return report
