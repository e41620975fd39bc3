import random

import corpus_pipeline as C
from llm_fixtures import table
from test_pipeline_stages import prose


def test_line_dedup_drops_a_long_passage_of_unlike_documents_but_not_of_copies(spark):
    r = random.Random(4)
    passage, shared = prose(r, 60), "All rights reserved"
    own = ["\n".join(prose(r, 25) for _ in range(5)) for _ in range(20)]
    rows = [(i, f"{t}\n{passage}\n{shared}", "en", "s", 0) for i, t in enumerate(own)]
    rows += [(100 + i, prose(random.Random(9), 150) + "\nline of copies", "en", "s", 0) for i in range(15)]
    got = {x.doc_id: x.text for x in C.line_dedup(spark, table(spark, rows), "").collect()}
    assert [got[i] for i in range(20)] == own
    assert all(got[100 + i] == rows[20 + i][1] for i in range(15))
