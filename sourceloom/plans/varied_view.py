"""A second corpus of source files, written from the customer table: several repositories, classes, methods, templates, odd line ends.

Every customer is a file of repository `r{nation % 7}`; even keys are Python, odd ones C++. Files of every tenth key that is 4 modulo 10 end
their lines in a lone carriage return; those of keys that are 6 modulo 30 are not valid UTF-8. What extraction must find follows from the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PYTHON = """import os
class Box{c}(Base):
    def get(self, x):
        return helper_{c}(x)

    def _hidden(self):
        return outer(inner_{c}(1))

def helper_{c}(x):
    return x

async def _private(y):
    def nested():
        deep()
    await go(y)

def main():
    run_{c}()"""
_CPP = """#include <map>
template <class T> class Box{c} : public Base<std::vector<T>> {
public:
  explicit Box{c}(int a) : n{a}, m{1} { made_{c}(a); }
  static int count(int q) { return q >> 1; }
private:
  T take() const { return g<std::vector<std::vector<T>>>(1); }
  int n; int m;
};
namespace in_{c} {
static int local(int x) { return x; }
}
int open_{c}(int x) {
  if (x < 1 && x > (0)) { local(x); }
  const char* s = R"(int no() { never(); })";
  return Box{c}<int>(x).take();
}"""


def varied_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path and raw bytes of all files."""
    c = F.col("c_custkey")
    text = F.replace(F.when(c % 2 == 0, _PYTHON).otherwise(_CPP), F.lit("{c}"), c.cast("string"))
    text = F.when(c % 10 == 4, F.replace(text, F.lit("\n"), F.lit("\r"))).otherwise(text)
    raw = F.concat(F.encode(text, "UTF-8"), F.when(c % 30 == 6, F.unhex(F.lit("c328"))).otherwise(F.unhex(F.lit(""))))
    path = F.concat(F.lit("src/c"), c, F.when(c % 2 == 0, ".py").otherwise(".cpp"))
    # dealt by number, as what is read out of the files is much more work than the bytes of these rows suggest
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey").repartition(parts, "c_custkey")
    return customers.select(F.concat(F.lit("r"), F.col("c_nationkey") % 7).alias("repo"), path.alias("path"), raw.alias("raw"))


#: The same corpus for DuckDB: files, definitions and calls.
VARIED_FACTS = """
    file AS (SELECT c_custkey AS c, 'r' || (c_nationkey % 7) AS repo, 'src/c' || c_custkey || (CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.cpp' END) AS path,
        CASE WHEN c_custkey % 2 = 0 THEN 'Python' ELSE 'C++' END AS language, c_custkey % 30 <> 6 AS good FROM customer),
    def0 AS (SELECT * FROM (VALUES
        ('Python', 0, NULL, 'Box{c}', 'class', 2, 7, NULL, ''), ('Python', 1, 0, 'get', 'method', 3, 4, true, 'helper_{c}'), ('Python', 2, 0, '_hidden', 'method', 6, 7, false, 'outer,inner_{c}'),
        ('Python', 3, NULL, 'helper_{c}', 'function', 9, 10, true, ''), ('Python', 4, NULL, '_private', 'function', 12, 15, false, 'go'), ('Python', 5, 4, 'nested', 'method', 13, 14, true, 'deep'),
        ('Python', 6, NULL, 'main', 'function', 17, 18, true, 'run_{c}'),
        ('C++', 0, NULL, 'Box{c}', 'class', 2, 9, NULL, ''), ('C++', 1, 0, 'Box{c}', 'method', 4, 4, NULL, 'made_{c}'), ('C++', 2, 0, 'count', 'method', 5, 5, NULL, ''),
        ('C++', 3, 0, 'take', 'method', 7, 7, NULL, 'g'), ('C++', 4, NULL, 'in_{c}', 'namespace', 10, 12, NULL, ''), ('C++', 5, 4, 'local', 'method', 11, 11, NULL, ''),
        ('C++', 6, NULL, 'open_{c}', 'function', 13, 17, true, 'local,Box{c},take')) t(language, pos, parent, name, symbol_type, start_line, end_line, is_public, calls)),
    def AS (SELECT repo, path, c, language, pos::INT AS pos, parent::INT AS parent, replace(name, '{c}', c::VARCHAR) AS name, symbol_type, start_line::INT AS start_line, end_line::INT AS end_line,
        is_public, replace(calls, '{c}', c::VARCHAR) AS calls FROM file JOIN def0 USING (language) WHERE good)"""
