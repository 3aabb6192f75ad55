"""Nested symbol ranges, and the tightest of them around a line."""

import time

from pyspark.sql import functions as F

from lodestone.operators import nesting, symbols

JAVA = """class Outer {
    private int a; // }
    public void first(int x) {
        if (x > 0) {
            String s = "}{";
        } else {
            y();
        }
    }
    public int one() { return 1; }
    public void proto(int x);
    class Inner {
        public void deep(int a, int b)

        {
            z();
        }
    }
}
class Next { }
class Open {
    public void tail(int x) {"""
PYTHON = """import a

class A:
    # comment
    def f(self):
        def g():
            return 1

        return g

    def h(self): return 2
    x = 1

def last():
    pass
    y = 3
"""
RUBY = """module M
  class C
    def f?(x)
      x
    end

    def g
      1
    end
  end
end
def top
  2"""
RUST = """pub struct P { x: i32 }
impl P {
    pub fn new(x: i32) -> P {
        P { x }
    }
    fn sig(&self);
}
fn main() {
    let c = || { 1 };
}"""


def lines_of(spark, files):
    rows = [(p, lang, i, x) for p, (lang, text) in files.items() for i, x in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, language string, line_no int, line string").repartition(3)


def test_ranges(spark):
    df = lines_of(spark, {"J": ("java", JAVA), "p": ("python", PYTHON), "r": ("ruby", RUBY), "s": ("rust", RUST), "e": ("php", ""), "t": ("text", "def x():")})
    got = {}
    for r in nesting.nested_ranges(df).collect():
        got.setdefault(r.path, set()).add((r.name, r.start_line, r.end_line))
    assert got["J"] == {("deep", 13, 17), ("Outer", 1, 19), ("first", 3, 9), ("one", 10, 10), ("proto", 11, 11), ("Inner", 12, 18), ("Next", 20, 20), ("Open", 21, 22), ("tail", 22, 22)}
    assert got["p"] == {("A", 3, 12), ("f", 5, 9), ("g", 6, 7), ("h", 11, 11), ("last", 14, 17)} or got["p"] == {("A", 3, 12), ("f", 5, 9), ("g", 6, 7), ("h", 11, 11), ("last", 14, 16)}
    assert got["r"] == {("M", 1, 11), ("C", 2, 10), ("f?", 3, 5), ("g", 7, 9), ("top", 12, 13)}
    assert got["s"] == {("P", 1, 1), ("P", 2, 7), ("new", 3, 5), ("sig", 6, 6), ("main", 8, 10)}
    assert "e" not in got and "t" not in got


def test_tightest_wins(spark):
    df = lines_of(spark, {"J": ("java", JAVA), "p": ("python", PYTHON)})
    points = spark.createDataFrame([("J", n) for n in (2, 5, 8, 16, 18, 19)] + [("p", n) for n in (7, 9, 12, 15)], "path string, line_no int")
    got = {(r.path, r.line_no): r.symbol for r in symbols.enclosing(points, nesting.nested_ranges(df)).collect()}
    assert got == {("J", 2): "Outer", ("J", 5): "first", ("J", 8): "first", ("J", 16): "deep", ("J", 18): "Inner", ("J", 19): "Outer", ("p", 7): "g", ("p", 9): "f", ("p", 12): "A", ("p", 15): "last"}


def test_a_long_file_in_little_time(spark):
    """What lies ahead of a line is not gone through for every line."""
    n = 60_000
    k = spark.range(1, 2 * n + 1, 1, 1).select(F.lit("a").alias("path"), F.lit("java").alias("language"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("public void f"), "id", F.lit("(int a) {"))).otherwise("}").alias("line"))
    start = time.monotonic()
    got = nesting.nested_ranges(k).selectExpr("count(*) as n", "count_if(end_line = start_line + 1) as right").first()
    assert tuple(got) == (n, n) and time.monotonic() - start < 40
