import pytest

pytest.importorskip("tagwave.llm")
