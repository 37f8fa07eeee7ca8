"""Markdown explanations of results: plain formatting of small rows that have been collected, no computation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def _table(head: list[str], rows: Iterable[Iterable]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(str(x).replace("|", "\\|") for x in r) + " |" for r in rows])


def explain_levenshtein(a: str, b: str, trace) -> str:
    """The table of prefix distances is only shown for texts of up to 15 characters."""
    out = [f"### Edit distance\n\nThe texts have {len(a)} and {len(b)} characters and are **{trace['distance']}** edits apart: similarity 1 - {trace['distance']} / {max(len(a), len(b), 1)} = **{trace['similarity']}**."]
    if max(len(a), len(b)) <= 15:
        out.append(_table(["", "∅", *b], ([x, *row] for x, row in zip(["∅", *a], trace["matrix"]))))
    return "\n\n".join(out)


def explain_jaccard(trace) -> str:
    shared = ", ".join(trace["intersection"][:20]) or "none"
    return f"### Shared words\n\n{trace['intersection_size']} of {trace['union_size']} different words are shared ({shared}): similarity **{trace['similarity']}**."


def explain_cosine(trace) -> str:
    """The ten words of greatest weight in either text, in the order of the vocabulary where equal."""
    rows = sorted(zip(trace["vocabulary"], trace["tfidf_vector_a"], trace["tfidf_vector_b"]), key=lambda r: -max(r[1], r[2]))[:10]
    return f"### TF-IDF vectors\n\n{_table(['word', 'first text', 'second text'], rows)}\n\nCosine of the two vectors: **{trace['similarity']}**."


def explain_hamming(trace) -> str:
    """The first five differences among the sampled positions."""
    different = [(i, s["char_a"], s["char_b"]) for i, s in enumerate(trace["comparisons_sample"]) if not s["match"]][:5]
    return f"### Position by position\n\n{trace['distance']} of {trace['total_positions']} positions differ: similarity **{trace['similarity']}**.\n\n{_table(['position', 'first', 'second'], different)}"


def explain_embedding(name: str, dimensions: int, similarity: float | None) -> str:
    shown = "not available" if similarity is None else f"**{similarity:.4f}**"
    return f"### {name}\n\nEach text is a vector of {dimensions} numbers; the cosine of the two, never below 0, is {shown}."


def explain_frequencies(coverage, counts: list) -> str:
    top = sorted(counts, key=lambda r: (-r["doc_frequency"], r["term"]))[:3]
    return f"### Category terms\n\n{coverage['n_category_docs']} of {coverage['n_abstracts']} abstracts ({coverage['category_coverage_pct']} %) hold a term of the category. Most frequent:\n\n{_table(['term', 'documents', 'occurrences'], ((r['term'], r['doc_frequency'], r['total_occurrences']) for r in top))}"


def explain_npmi(terms: list) -> str:
    rows = ((r["npmi_rank"], r["term"], r["npmi"], r["doc_frequency"]) for r in sorted(terms, key=lambda r: r["npmi_rank"])[:3])
    return f"### Associated terms\n\nNPMI is log2(P(w,c) / (P(w) P(c))) divided by -log2 P(w,c): 1 always together, 0 independent, -1 never.\n\n{_table(['rank', 'term', 'NPMI', 'documents'], rows)}"


def explain_precision(rated: list) -> str:
    bands: dict[str, int] = {}
    for r in rated:
        bands[r["precision_label"]] = bands.get(r["precision_label"], 0) + 1
    return f"### Precision\n\nThe share of a term's documents that hold a term of the category.\n\n{_table(['band', 'terms'], sorted(bands.items()))}"


def explain_preprocessing(text: str, tokens: list[str]) -> str:
    return f"### Preparing the text\n\n{len(text)} characters become {len(tokens)} stems: {', '.join(tokens[:15])}."


def explain_tfidf(weights: list) -> str:
    top = sorted(weights, key=lambda r: (-r["weight"], r["term"]))[:10]
    return f"### Weights\n\nTF is the share of a document's words, IDF is ln((N + 1) / (df + 1)) + 1.\n\n{_table(['term', 'weight'], ((r['term'], round(r['weight'], 4)) for r in top))}"


def explain_distances(stats) -> str:
    return f"### Distances\n\n1 - cosine of the weights. Least {stats['min_d']:.4f}, greatest {stats['max_d']:.4f}, mean {stats['mean_d']:.4f}, deviation {stats['std_d']:.4f}."


_RULES = {"complete": "the greatest distance between members", "average": "the mean distance between members", "ward": "the growth of the squared deviations"}


def explain_linkage(method: str, merges: list) -> str:
    first = sorted(merges, key=lambda r: r["step"])[:3]
    return f"### {method.title()} linkage\n\nTwo clusters are as far apart as {_RULES[method]}. First merges:\n\n{_table(['step', 'a', 'b', 'height', 'size'], ((r['step'], r['a'], r['b'], round(r['dist'], 4), r['size']) for r in first))}"


def explain_cophenetic(scores: list) -> str:
    return f"### Quality\n\nThe correlation of merge heights with distances.\n\n{_table(['method', 'correlation'], ((r['method'], round(r['cophenetic'], 4)) for r in scores))}"


def explain_geography(rows: list) -> str:
    return f"### Countries\n\nThe country of each first author.\n\n{_table(['country', 'publications'], ((r['country'], r['n']) for r in rows[:20]))}"


def explain_words(rows: list, weight: int = 3) -> str:
    return f"### Words\n\nWords of abstracts count once, keywords {weight} times.\n\n{_table(['term', 'frequency'], ((r['term'], r['freq']) for r in rows[:10]))}"


def explain_timeline(figures) -> str:
    return f"### Years\n\n{figures['total']} publications in {figures['n_years']} years, most in {figures['peak_year']}, from {figures['n_sources']} sources."


def explain_report(tables: Mapping[str, object]) -> str:
    return "### Report\n\nA cover and three pages, made from the tables " + ", ".join(f"`{t}`" for t in tables) + "."


EXPLANATIONS = {"levenshtein": explain_levenshtein, "jaccard": explain_jaccard, "cosine_tfidf": explain_cosine, "hamming": explain_hamming}
