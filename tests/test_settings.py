from pathlib import Path

import pytest

from veritrail.operators.classify import TOPICS
from veritrail.settings import Settings


def test_defaults_and_environment():
    assert Settings().topic_keywords == TOPICS and Settings().retrieval_top_k == 12
    got = Settings.from_env({"VERITRAIL_CHUNK_MAX_CHARS": "300", "VERITRAIL_TOPIC_KEYWORDS": " Skills, , Work ", "VERITRAIL_KB_EXCLUDE_GLOBS": '["a/**", " B "]', "VERITRAIL_KB_DIR": "~/kb", "VERITRAIL_NOPE": "1", "PATH": "/bin"})
    assert (got.chunk_max_chars, got.topic_keywords, got.kb_exclude_globs, got.kb_dir) == (300, ("skills", "work"), ("a/**", "b"), Path("~/kb").expanduser())
    assert Settings.from_env({"VERITRAIL_TOPIC_KEYWORDS": ""}).topic_keywords == ()


@pytest.mark.parametrize("wrong", [{"chunk_max_chars": 0}, {"chunk_overlap_chars": 1200}, {"chunk_overlap_chars": -1}, {"retrieval_top_k": 0}, {"similarity_threshold": 1.5}, {"topic_keywords": "[1"}, {"max_message_chars": "x"}])
def test_wrong_values_are_refused(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)
