import numpy as np

from phenogrid.llm import common, lines


def test_lines_that_share_a_run_at_other_places_make_no_rows(spark):
    """Of three lines with one run in common two have it at the end; a run that a line repeats has no place."""
    other = iter(f"u{i}" for i in range(10000))

    def line(n, at):
        words = [next(other) for _ in range(n)]
        for i in at:
            words[i : i + 2] = "rare", "run"
        return " ".join(words)

    rarity = np.zeros(lines.WORD_BUCKETS, dtype=np.uint8)
    for texts, rows in (([line(30, [2]), line(30, [26])], 0), ([line(30, [2]), line(30, [26]), line(30, [25])], 2), ([line(30, [2, 20]), line(30, [26])], 2), ([line(40, [i % 30]) for i in range(40)], 40)):
        # all runs of a line are keys, so that the shared one is among them
        keep = lines.run_counts
        lines.run_counts = lambda n, least: [n, 0]
        try:
            splitter = lines.LineSplitter()
            with np.errstate(over="ignore"):
                made = [(key, g["h1"][of], common.size_codes(g["n"])[of], places) for t in texts for g in splitter(lines.pa.array([t])) for of, key, places in [lines.run_keys(g["words"], g["first"], g["n"], rarity, 0.8)]]
                batches = [b for m in made for b in common.pack_entries(*m[:3], 1, m[3])]
        finally:
            lines.run_counts = keep
        entries = spark.createDataFrame([r for b in batches for r in zip(*(b.column(c).to_pylist() for c in b.schema.names))], common.PLACED_SCHEMA)
        assert common.shared_rows(entries, common.code_span(0.8), 1 - 0.8).count() == rows
