"""A small documents table with the awkward rows every operator must take, plus clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Verdict string, kept string, fp long, component string, n_lines int, line string"


def texts(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij é") for _ in range(r.randint(1, 9))).replace(" ", "x") for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(220)
    near = base.split()
    near[50] = "changed"
    shared = say(90)
    out = [base, base, base, " ".join(near), None, None, "", "", "   \n\t ", "one", "Two words", "THREE Small Words", say(30) + "\n" + say(20)]
    out += [say(60) + " " + shared + " " + say(60) for _ in range(4)]
    out += ["Home | About\n" + say(25) + "\n\nAll rights reserved." for _ in range(14)]
    out += [say(9000), "日本語 テキスト ééé ß Σ İ", "a" * 5000, "x y " * 400, " nbsp em\x1cfs\x85 end", "it's DON'T l'été, 12345 $$$ !!! #1 a.b"]
    out += [say(r.randint(5, 200)) for _ in range(25)]
    return out


def documents(spark, empty=False):
    rows = [] if empty else [(i, t, "en", None if i == 7 else f"s{i % 2}", len(t) if t else None, "v", "k", 5, "c", 1, "l") for i, t in enumerate(texts())]
    if rows:
        rows += [rows[0], rows[12]]
        rows.append((None, rows[3][1], *rows[3][2:]))
    return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
