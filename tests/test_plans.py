from pagegrain.operators import answers, spacing
from pagegrain.plans import analysis, provider
from pagegrain.sources import adapters, decode


class Fixed:
    def complete(self, prompt):
        return provider.Answer('```json\n{"per_page_analysis": [{"page_index": 1, "section_headings": [{"text": "S"}]}]}\n```', len(prompt) // 4, 9, "fixed")


def test_from_lines_to_elements(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20")
    lines = spacing.with_gaps(adapters.layout_lines(docs))
    prompts = analysis.sampled_prompts(lines)
    assert prompts.count() == docs.where("trim(text) <> ''").count()
    cost = analysis.estimated_cost(prompts).collect()
    assert all(abs(r.cost_usd - (r.prompt_tokens / 1000 * 0.03 + 0.06)) < 1e-9 for r in cost)
    found = analysis.asked(prompts, Fixed())
    rows = answers.elements(answers.pages(found)).collect()
    assert len(rows) == prompts.count() and {r.text for r in rows} == {"S"}
    assert analysis.status(Fixed(), found) == {"configured": True, "answers": len(rows)} and analysis.status(None, None) == {"configured": False, "answers": 0}


def read(content):
    if not content.startswith(b"ok"):
        raise ValueError("not a document")
    for i, w in enumerate(content.decode().split()[1:]):
        yield {"page": 1, "text": w, "x0": i * 10.0, "x1": i * 10.0 + 8, "top": 10.0, "bottom": 20.0, "fontname": "F", "size": 10.0, "upright": True, "page_width": 600.0, "page_height": 800.0}


def test_decoders_and_files_that_fail(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok one two")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"ok three")
    words = decode.decoded(spark, str(tmp_path), read)
    assert sorted(r.text for r in words.where("problem IS NULL").collect()) == ["one", "two"]
    assert [r.problem for r in decode.problems(words).collect()] == ["ValueError: not a document"]
