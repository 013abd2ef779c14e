import pytest

pytest.importorskip("cohortsmith.llm")
