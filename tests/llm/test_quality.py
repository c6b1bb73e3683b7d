import re

from tessera.llm import quality as Q


def counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in many for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


TEXTS = [None, "", " \t\n", "a b c a b c", "a\nb\n a\na\n\n\n", "x y z x y z x y z", "# * $ % & | < > é ü", "w " * 60,
         " ".join(f"w{i}" for i in range(5000)), "one two three\r\none two three\x0bfour " * 30, "a b", "\n".join(["same line here"] * 40),
         "the of " + " ".join(f"w{i} and" for i in range(100))]


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    rows = {r.doc_id: r for r in Q.apply_rules(df.unionAll(df)).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t), t
        assert r.kept is not None and not (r.base_failed and r.kept)
    assert rows[len(TEXTS) - 1].kept


def test_no_python_in_the_plan(spark):
    df = Q.apply_rules(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_empty_table(spark):
    assert Q.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
