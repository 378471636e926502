"""Literal documents, pages, manifests and candidates for the tests of versions."""

from pyspark.sql import functions as F

from lanternlake.operators import temporal as X

#: (source, content): versions, audiences, an abbreviation, a bridge that must not merge two families.
DOCUMENTS = [
    ("1. HDSD EOS 01.02.2024.pdf", "sinh vien dang nhap he thong lam bai kiem tra tren may tinh"),
    ("Hướng dẫn sử dụng EOS 15.03.2024.pdf", "sinh vien dang nhap he thong lam bai kiem tra tren may tinh moi"),
    ("Hướng dẫn sử dụng EOS speaking 20.03.2024.pdf", "speaking test va speaking phong thi"),
    ("Quy chế thi GV 10.01.2023.docx", "giam thi coi thi phong may giam thi"),
    ("Quy chế thi GV 12.01.2024 final.docx", "giam thi coi thi phong may giam thi ky luat"),
    ("Quy chế phòng máy.docx", "noi quy phong may"),
    ("Hướng dẫn.pdf", "huong dan chung"),
    ("Lịch thi spring 2024.xlsx", "lich thi cac mon"),
    ("Lich thi fall 2023.xlsx", "lich thi cac mon khac"),
    ("02.02.2024.pdf", "khong co ten"),
]


def documents(s):
    return s.createDataFrame(DOCUMENTS, "source string, content string")


PAGES = [
    (1, "Phien ban EOSClient.zip ngay 01.02.2024"), (2, "khong dau hieu 01.02.2024"), (3, "update 05.06.2024"),
    (4, "lich thi ngay thi 01.02.2024 version PEALogin"), (5, "tai phan mem: PEALogin 1.2.2024 va PEALogin 3.4.2024 update"), (6, None),
]


GENERATED = [("a.pdf", "f1", "2024-01-01", "candidate"), ("b.pdf", "f1", "2024-03-01", "candidate"), ("c.pdf", "f2", "2023-05-05", "candidate"), ("d.pdf", "f1", "2024-03-01", "candidate")]
MANUAL = [("b.pdf", "f1", "2023-12-01", "verified"), ("e.pdf", "f2", "2024-06-06", "verified"), ("c.pdf", None, None, "verified")]
TYPES = "source string, family_id string, day string, temporal_status string"


def merged(s):
    return X.merge_manifests(s.createDataFrame(GENERATED, TYPES), s.createDataFrame(MANUAL, TYPES))


ROWS = [("a", None, "f", 1), ("a", None, "f", 2), ("b", 1, "f", 0), ("", 2, " ", 1), ("c", 0, "g", None), (None, 3, "g", 1)]


CHUNKS = [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.pdf", 1, "three"), ("c.pdf", 1, "four"), ("e.pdf", 1, "five"), ("zz.pdf", 1, "six"), ("d.pdf", 1, "seven")]
OVERRIDES = [("a.pdf", 2, "f9", "2024-09-09", 2, "verified", "seen on the screen"), ("b.pdf", 1, None, None, 5, None, None)]


def enriched(s):
    chunks = s.createDataFrame(CHUNKS, "source string, page int, text string")
    over = s.createDataFrame(OVERRIDES, "source string, page int, family_id string, day string, version_rank int, temporal_status string, verified_visual_fact string")
    return X.enrich(chunks, merged(s), over)


#: (query_id, query, family_id, version_rank, cand_id, source, heading, content, score, position)
CANDIDATES = [
    (1, "cài đặt EOS SEB-101", "f1", 1, 10, "old.pdf", "EOS", "cai dat EOS ma loi SEB-101 tren may", 0.5, 0),
    (1, "cài đặt EOS SEB-101", "f1", 2, 11, "new.pdf", "EOS", "cai dat EOS phien ban khac", 0.6, 1),
    (1, "cài đặt EOS SEB-101", "f2", 2, 12, "only.pdf", None, "noi dung khac", 0.2, 2),
    (2, "phiên bản mới nhất của EOS", "f1", 1, 10, "old.pdf", "EOS", "phien ban EOS cu", 0.4, 0),
    (2, "phiên bản mới nhất của EOS", "f1", 2, 11, "new.pdf", "EOS", "EOS moi", 0.3, 1),
    (2, "phiên bản mới nhất của EOS", "f2", 1, 13, "older.pdf", None, "EOS ban truoc", 0.2, 2),
    (3, "quy định phòng thi", "f2", 1, 13, "older.pdf", None, "quy dinh phong thi day du", 0.5, 0),
    (3, "quy định phòng thi", "f9", 1, 14, "free.pdf", None, "quy dinh", 0.3, 1),
    (4, "đăng nhập wifi", "f1", 1, 10, "old.pdf", "Mạng", "dang nhap wifi bang tai khoan", 0.5, 0),
    (4, "đăng nhập wifi", "f1", 2, 11, "new.pdf", "Mạng", "dang nhap wifi bang tai khoan moi", 0.5, 1),
]
CANDIDATE_TYPES = "query_id int, query string, family_id string, version_rank int, cand_id int, source string, heading string, content string, score double, position int"
NEWEST = [("f1", 2, 11, "new.pdf", "EOS", "EOS moi"), ("f2", 2, 12, "only.pdf", None, "noi dung khac"), ("f2", 2, 15, "only.pdf", None, "EOS phien ban moi nhat")]


def candidates(s):
    return s.createDataFrame(CANDIDATES, CANDIDATE_TYPES).withColumn("section_path", F.col("heading"))



def discovered(s):
    return X.discover(documents(s), s.createDataFrame([("notes.pdf", i, t) for i, t in PAGES], "source string, page int, content string"))


def resolved(s):
    newest = s.createDataFrame(NEWEST, "family_id string, version_rank int, cand_id int, source string, heading string, content string")
    eligible = s.createDataFrame([("f1", 2, 2), ("f2", 2, 2)], "family_id string, newest_rank int, n_ranks int")
    return X.resolve(candidates(s), eligible, newest.withColumn("section_path", F.col("heading")))


ASKED = [(1, "bản mới nhất"), (2, "Current VERSION?"), (3, "bản cũ"), (4, None)]
