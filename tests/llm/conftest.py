import pytest

pytest.importorskip("inkstream.llm.queries")
