"""A Spec turned into a pipeline: transforms, a coarse quantizer, a code, a search, a refinement.

Training gives small models; add() turns rows into what is stored (vectors, codes, lists, a graph), once, in the shared
folder; a search reads that and trains or builds nothing, and gives qid, rank, id, dist. An Index never changes: train(),
add() and remove() return another. nearfield.sources.indexes writes and reads one. Distances are those of the codes
unless the Spec refines.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.metrics import descending
from nearfield.operators import binary, cluster, codecs, learned, search, sphere, stats, transforms
from nearfield.operators.additive import AdditiveQuantizer
from nearfield.operators.coded_lists import CodedLists, ProductCells, product_codes, product_vectors
from nearfield.operators.graph import GraphIndex
from nearfield.operators.ivf import InvertedFile
from nearfield.operators.lineage import cut
from nearfield.operators.spectral import SpectralLists
from nearfield.plans.spec import BinarySpec, Spec, Step, parse, parse_binary

_SH_KINDS = {"g": "global", "c": "centroid", "m": "median"}


def _transform(step: Step, rows: DataFrame, d: int) -> Any:
    a = step.args
    if step.name == "PCA":
        return transforms.pca(rows, a[2], -0.5 if a[0] else 0.0, 1234 if a[1] else None)
    if step.name == "L2norm":
        return transforms.Normalize()
    if step.name == "RR":
        return transforms.random_rotation(d, a[0] or d)
    if step.name == "HR":
        return transforms.Hadamard(d, a[0])
    if step.name == "ITQ":
        return learned.itq(rows, a[0])
    if step.name == "OPQ":
        return learned.opq(rows, a[0], d_out=a[1])
    return transforms.pad(d, a[0])


def _quantizer(code: Step, rows: DataFrame, d: int) -> Any:
    a = code.args
    if code.name == "SQ" and a[0] in (4, 6, 8):
        return codecs.ScalarQuantizer.fit(rows, a[0])
    if code.name in ("PQ", "PQR"):
        return codecs.ProductQuantizer.fit(rows, a[0], a[1] if code.name == "PQ" else 8)
    if code.name in ("RQ", "LSQ"):
        return AdditiveQuantizer.fit(rows, a[0], a[1], code.name.lower())
    if code.name in ("PRQ", "PLSQ"):
        return AdditiveQuantizer.fit(rows, a[1], a[2], code.name[1:].lower(), parts=a[0])
    if code.name == "RaBitQ":
        return sphere.SignMagnitude(transforms.Center.fit(rows).mean, a[0])
    if code.name == "Zn":
        return sphere.SphereCodec.fit(rows, d, *a)
    if code.name == "LSH":
        return codecs.SignHash.fit(rows, a[0] or d) if a[2] else codecs.SignHash(a[0] or d)
    return None


def _dim(rows: DataFrame) -> int:
    found = rows.agg(F.max(F.size("vec"))).first()[0]
    if found is None:
        raise ValueError("no vectors to train on")
    return int(found)


@dataclass(frozen=True)
class Index:
    """stored: what add() made; copies: (id, copy) of a set without repeated vectors; exact: rows (id, vec) to refine with;
    refiner: another index whose codes refine."""

    spec: Spec
    metric: str = "l2"
    chain: tuple = ()
    quantizer: Any = None
    centroids: DataFrame | None = None
    coarse: GraphIndex | None = None
    cells: ProductCells | None = None
    fine: codecs.ProductQuantizer | None = None
    stored: DataFrame | None = None
    thresholds: DataFrame | None = None
    copies: DataFrame | None = None
    exact: DataFrame | None = None
    refiner: Index | None = None
    seed: int = 1234

    @classmethod
    def of(cls, text: str, metric: str = "l2") -> Index:
        return cls(parse(text), metric)

    def _moved(self, rows: DataFrame) -> DataFrame:
        rows = rows.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        for t in self.chain:
            rows = t.apply(rows)
        return rows

    # --- training

    def train(self, rows: DataFrame) -> Index:
        out = self
        for step in self.spec.transforms:
            moved = out._moved(rows)
            out = replace(out, chain=(*out.chain, _transform(step, moved, _dim(moved))))
        x, code, coarse = out._moved(rows), self.spec.code, self.spec.coarse
        if self.spec.refine and self.spec.refine != "Flat":
            out = replace(out, refiner=Index.of(self.spec.refine, self.metric).train(rows))
        if self.spec.scaled and code.name != "SQ":
            raise ValueError("row scaling goes with a scalar code")
        if self.metric != "l2" and (self.spec.graph or (coarse and coarse.name == "IMI")):
            raise ValueError("graphs and product cells need L2")
        if code.name == "LSH" and code.args[1]:
            d = _dim(x)
            out = replace(out, chain=(*out.chain, transforms.random_rotation(d, code.args[0] or d)))
            x = out._moved(rows)
        if coarse is None:
            return out if self.spec.scaled else replace(out, quantizer=_quantizer(code, x, _dim(x)))
        if coarse.name == "IMI":
            out = replace(out, cells=ProductCells(codecs.ProductQuantizer.fit(x, 2, coarse.args[0])))
            file = out.cells.file(x)
        else:
            found = cluster.kmeans(x, coarse.args[0], 10, seed=self.seed, spherical=descending(self.metric))
            out = replace(out, centroids=cut(found.table(rows.sparkSession)))
            if coarse.name == "IVF" and coarse.args[1]:
                if self.metric != "l2":
                    raise ValueError("a graph over centroids needs L2")
                out = replace(out, coarse=GraphIndex.build(out.centroids.select(F.col("list_no").cast("long").alias("id"), "vec"), coarse.args[1].lower(), coarse.args[2] or 32))
            file = InvertedFile.build(x, out.centroids, self.metric)
        if code.name == "SH" and code.args[1] == "m":
            out = replace(out, thresholds=cut(SpectralLists.build(file, float(code.args[0]), "median", _dim(x)).thresholds))
        residuals = file.residuals()
        if code.name == "PQR":
            first = _quantizer(code, residuals, 0)
            near = product_vectors(product_codes(residuals, first), first, "code", "near")
            left = near.select("id", F.zip_with("vec", "near", lambda a, b: a - b).alias("vec"))
            return replace(out, quantizer=first, fine=codecs.ProductQuantizer.fit(left, code.args[1]))
        return replace(out, quantizer=_quantizer(code, residuals, _dim(x)))

    # --- what is stored

    def add(self, rows: DataFrame) -> Index:
        """Rows (id, vec). A graph is built anew over what it held and the new rows; all other forms only gain rows."""
        rows, out = rows.select("id", "vec"), self
        if self.spec.refine == "Flat":
            exact = cut(rows.where("vec is not null"))
            out = replace(out, exact=exact if self.exact is None else self.exact.unionByName(exact))
        elif self.spec.refine:
            out = replace(out, refiner=self.refiner.add(rows))
        x = self._moved(rows)
        if self.spec.code.name == "FlatDedup":
            if self.copies is not None:
                x = x.unionByName(self.copies.join(self.decoded(self.stored), "id").select(F.col("copy").alias("id"), "vec"))
            x = cut(x)
            one = cut(stats.distinct_vectors(x).select("id", "vec"))
            return replace(out, copies=cut(stats.copies(x, one)), stored=cut(self._kept(one)))
        if self.spec.graph:
            held = None if self.stored is None else self.decoded(self.stored)
            return replace(out, stored=self._graph(x if held is None else held.unionByName(x)))
        new = cut(self._kept(x))
        return replace(out, stored=new if self.stored is None else self.stored.unionByName(new))

    def add_codes(self, rows: DataFrame) -> Index:
        """Rows that are already in the stored form."""
        if self.spec.graph or self.copies is not None:
            raise ValueError("a graph takes vectors, not codes")
        return replace(self, stored=rows if self.stored is None else self.stored.unionByName(rows.select(*self.stored.columns)))

    def remove(self, ids: DataFrame) -> Index:
        gone = ids.select(F.col("id").cast("long").alias("id")).distinct()
        without = lambda t, c="id": t if t is None else t.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*t.columns)
        out = replace(self, exact=without(self.exact), refiner=None if self.refiner is None else self.refiner.remove(ids))
        if self.copies is not None:
            return replace(out, copies=without(self.copies, "copy"))
        if self.spec.graph:
            return replace(out, stored=self._graph(without(self.decoded(self.stored))))
        return replace(out, stored=without(self.stored))

    def merge(self, other: Index) -> Index:
        """The rows of two indexes of the same training."""
        if self.spec != other.spec or self.metric != other.metric or self.quantizer is not other.quantizer or self.chain is not other.chain or self.centroids is not other.centroids:
            raise ValueError("only indexes of one training can be merged")
        if self.spec.graph or self.copies is not None:
            raise ValueError("add the rows instead")
        both = lambda a, b: a.unionByName(b) if a is not None and b is not None else a if b is None else b
        return replace(self, stored=both(self.stored, other.stored), exact=both(self.exact, other.exact), refiner=self.refiner.merge(other.refiner) if self.refiner else None)

    def _graph(self, x: DataFrame) -> DataFrame:
        g = self.spec.graph
        return GraphIndex.build(x, g.name.lower(), g.args[0], codec=self.quantizer).rows

    def _file(self, rows: DataFrame | None = None) -> InvertedFile:
        if self.cells:
            none = (self.stored if rows is None else rows).select("list_no").limit(0).selectExpr("list_no", "cast(null as array<double>) as vec")
            return InvertedFile(self.stored if rows is None else rows, none, self.metric)
        return InvertedFile(self.stored if rows is None else rows, self.centroids, self.metric)

    def _kept(self, x: DataFrame) -> DataFrame:
        """Moved rows in the stored form."""
        code, q = self.spec.code, self.quantizer
        if self.spec.coarse:
            file = self.cells.file(x) if self.cells else InvertedFile.build(x, self.centroids, self.metric)
            if code.name in ("Flat", "FlatDedup"):
                return file.rows
            if code.name == "SH":
                return self._spectral(file).rows
            if code.name in ("PQ", "PQR"):
                return CodedLists.build(file, q, self.fine).rows
            return self._code(file.residuals()).drop("vec")
        if code.name == "LSH":
            return q.encode(x)
        if code.name in ("Flat", "FlatDedup"):
            return x
        return self._code(x).drop("vec")

    def _code(self, rows: DataFrame) -> DataFrame:
        """rows with the column code of vec."""
        code, q = self.spec.code, self.quantizer
        if self.spec.scaled:
            return rows.withColumn("code", codecs.row_scaled(F.col("vec"), int(str(code.args[0])[0]), self.spec.scaled == "MinMaxFP16"))
        if code.name == "SQ" and q is None:
            if "16" in str(code.args[0]):
                return rows.withColumn("code", codecs.half(F.col("vec"), code.args[0]))
            low = -128 if "signed" in code.args[0] else 0
            return rows.withColumn("code", F.transform("vec", lambda x: F.greatest(F.lit(low), F.least(F.lit(low + 255), F.floor(x))).cast("double")))
        return codecs.appended(rows, "vec", "code", "long" if code.name == "Zn" else "double", q.encode_matrix)

    def decoded(self, rows: DataFrame) -> DataFrame:
        """Stored rows (some or all) as id, vec: in lists with list_no. Vectors are those after the transforms."""
        code, q = self.spec.code, self.quantizer
        if self.spec.graph:
            return rows.select("id", "vec") if q is None else codecs.appended(rows.select("id", F.col("vec").alias("code")), "code", "vec", "double", q.decode_matrix).select("id", "vec")
        if code.name in ("Flat", "FlatDedup"):
            return rows
        if code.name in ("SH", "LSH"):
            raise ValueError("bits give no vectors back")
        if self.spec.coarse and code.name in ("PQ", "PQR"):
            return CodedLists(rows, self._centroid_rows(rows), q, self.fine, self.metric).decode()
        if self.spec.scaled:
            out = rows.withColumn("vec", codecs.row_unscaled(F.col("code"), int(str(code.args[0])[0])))
        elif q is None:
            out = rows.withColumn("vec", F.col("code"))
        else:
            out = codecs.appended(rows, "code", "vec", "double", q.decode_matrix, whole=code.name == "Zn")
        out = out.drop("code")
        if self.spec.coarse:
            c = self._centroid_rows(rows).select("list_no", F.col("vec").alias("c"))
            out = out.join(c, "list_no").select("list_no", "id", F.zip_with("vec", "c", lambda a, b: a + b).alias("vec"))
        return out

    def _centroid_rows(self, rows: DataFrame) -> DataFrame:
        if not self.cells:
            return self.centroids
        k = self.cells.pq.codebook.shape[1]
        used = rows.select("list_no").distinct().withColumn("code", F.array(F.col("list_no") % k, F.floor(F.col("list_no") / k)))
        return product_vectors(used, self.cells.pq).select("list_no", "vec")

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        """id, vec of stored rows as given to add(), as far as code and transforms can be undone."""
        found = self.decoded(self.stored.join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").select(*self.stored.columns)).select("id", "vec")
        for t in reversed(self.chain):
            found = t.reverse(found)
        return found

    def _spectral(self, file: InvertedFile) -> SpectralLists:
        code, d = self.spec.code, len(file._lists[1][0])
        if self.thresholds is not None:
            return SpectralLists.with_thresholds(file, self.thresholds, float(code.args[0]), d)
        return SpectralLists.build(file, float(code.args[0]), _SH_KINDS[code.args[1]], d)

    # --- search

    def probes(self, q: DataFrame, nprobe: int) -> DataFrame:
        """qid, list_no of moved queries."""
        if self.cells:
            return self.cells.probes(q, nprobe)
        if self.coarse is not None:
            return self.coarse.search(q, nprobe, max(64, 2 * nprobe)).select("qid", F.col("id").cast("int").alias("list_no"), "rank", F.col("dist").alias("coarse"))
        return InvertedFile(self.centroids, self.centroids, self.metric).probes(q, nprobe)

    def _first(self, q: DataFrame, k: int, nprobe: int, ef: int, screen: int | None, where) -> DataFrame:
        code, spec, stored = self.spec.code, self.spec, self.stored if where is None else self.stored.where(where)
        if spec.graph:
            return GraphIndex(stored, self.quantizer).search(q, k, ef)
        if code.name == "LSH":
            return binary.hamming_knn(self.quantizer.encode(q), stored, k).withColumn("dist", F.col("dist").cast("double"))
        if spec.coarse is None:
            if code.name == "PQ":
                return self.quantizer.search(q, stored, k, self.metric)
            return search.knn_join(q, self.decoded(stored), k, self.metric)
        if spec.coarse.name == "Residual":
            raise ValueError("a two-layer code has no search of its own: refine it or decode it")
        probes = self.probes(q, nprobe)
        if code.name == "SH":
            file = InvertedFile(stored, self.centroids, self.metric)
            t = self.thresholds if self.thresholds is not None else self._spectral(InvertedFile(self.centroids.selectExpr("list_no", "cast(0 as bigint) as id", "vec").limit(0), self.centroids)).thresholds
            return SpectralLists(file, stored, t, float(code.args[0]), len(file._lists[1][0])).search(q, k, nprobe).withColumn("dist", F.col("dist").cast("double"))
        if code.name in ("PQ", "PQR") and self.cells is None:
            lists = CodedLists(stored, self.centroids, self.quantizer, self.fine, self.metric)
            return lists.search_refined(q, k, nprobe, probes=probes) if self.fine is not None else lists.search(q, k, nprobe, screen, probes=probes)
        return InvertedFile(self.decoded(stored), self._file(stored).centroids, self.metric).search_preassigned(q, probes, k)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, ef: int = 16, factor: float = 1.0, screen: int | None = None, where=None) -> DataFrame:
        """where: a condition on the id, which holds before the search (not in graphs)."""
        if self.stored is None:
            raise ValueError("nothing was added")
        if where is not None and (self.spec.graph or self.copies is not None):
            raise ValueError("a condition would cut the graph, or hide copies: filter the result instead")
        many = int(k * factor) if self.spec.refine else k
        hits = self._first(self._moved(queries), many, nprobe, ef, screen, where)
        if self.copies is not None:
            hits = search.ranked(stats.expanded(hits, self.copies), many, self.metric).select("qid", "rank", "id", "dist")
        if not self.spec.refine:
            return hits
        fine = self.exact if self.refiner is None else self.refiner.decoded(self.refiner.stored)
        q = queries if self.refiner is None else self.refiner._moved(queries)
        return search.refined(hits, q, fine.select("id", "vec"), k, self.metric)


@dataclass(frozen=True)
class BinaryIndex:
    """An index of codes (id, words) of n bits from a description: BFlat, BIVF16, BIVF16_HNSW8, BHNSW16, BHash8, BHash2x8."""

    spec: BinarySpec
    n: int
    lists: binary.BinaryLists | None = None
    graph: binary.BinaryGraph | None = None
    stored: DataFrame | None = None

    @classmethod
    def of(cls, text: str, n: int) -> BinaryIndex:
        return cls(parse_binary(text), n)

    def train(self, rows: DataFrame) -> BinaryIndex:
        if self.spec.kind != "IVF":
            return self
        lists = binary.BinaryLists.fit(rows, self.spec.args[0], self.n)
        m, graph = self.spec.args[1], None
        if m:
            graph = binary.BinaryGraph.build(lists.file.centroids.select(F.col("list_no").cast("long").alias("id"), F.col("vec").alias("words")), self.n, m)
        return replace(self, lists=lists, graph=graph)

    def add(self, rows: DataFrame) -> BinaryIndex:
        rows = rows.where("words is not null").select(F.col("id").cast("long").alias("id"), "words")
        if self.spec.kind == "IVF":
            file = self.lists.file
            new = cut(file.assigned(binary.as_vectors(rows)))
            old = file.rows if self.stored is None else self.stored
            both = new if self.stored is None else old.unionByName(new)
            return replace(self, stored=both, lists=replace(self.lists, file=replace(file, rows=both)))
        every = cut(rows) if self.stored is None else self.stored.unionByName(cut(rows))
        return replace(self, stored=every, graph=binary.BinaryGraph.build(every, self.n, self.spec.args[0]) if self.spec.kind == "HNSW" else None)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, ef: int = 32, flip: int = 0) -> DataFrame:
        """qid, rank, id, dist. A hash index gives what shares a bucket after at most `flip` flips."""
        kind = self.spec.kind
        if kind == "Flat":
            return binary.hamming_knn(queries, self.stored, k)
        if kind == "HNSW":
            return self.graph.search(queries, k, ef)
        if kind == "Hash":
            many, b = self.spec.args[0] or 1, self.spec.args[1]
            hits = binary.bucket_range(queries, self.stored, self.n + 1, b, flip, tuple(b * i for i in range(many)))
            return search.ranked(hits.withColumn("dist", F.col("dist").cast("double")), k).select("qid", "rank", "id", F.col("dist").cast("int").alias("dist"))
        if self.graph is None:
            return self.lists.search(queries, k, nprobe)
        probes = self.graph.search(queries, nprobe, max(ef, 2 * nprobe)).select("qid", F.col("id").cast("int").alias("list_no"))
        return self.lists.file.search_preassigned(binary.as_vectors(queries), probes, k).withColumn("dist", F.col("dist").cast("int"))
