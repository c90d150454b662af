"""Fixed values of the evidence engine: word lists, weights, limits and phrase pairs that results depend on."""

# --- fixed values -------------------------------------------------------------------------------------------------
STOP_WORDS = """the and for with that this from into your must now are all per there page include includes includ contain contains list built flow
runtime plan touch browser both modern feature app model style""".split()
ANCHOR_STOP_WORDS = "support avail available feature features modern app apps model provid replac service system platform".split()
QUALIFIERS = "all every fully native global worldwide only always never entire default maximum minimum max min".split()
RELEASE_WORDS = "upgrade upgrading changelog release releases remix migration migrat".split()
CONTEXT_STOP_WORDS = "a an the and or as at be been being by for from in into is its of on that their this those to with".split()
STEM_SUFFIXES = ["ing", "ed", "ly", "es", "s"]
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
CLAUSE_MARKERS = [", but ", " but ", ", however ", " however ", ", while ", " while ", " whereas "]
UNITS = {
    "second": "second seconds sec secs", "minute": "minute minutes min mins", "hour": "hour hours hr hrs", "day": "day days",
    "week": "week weeks", "month": "month months", "year": "year years",
}
MONTHS = "january february march april may june july august september october november december".split()
POLARITY = [
    ("available", "not available"), ("available", "unavailable"), ("required", "not required"), ("allowed", "not allowed"),
    ("supported", "not supported"), ("enabled", "not enabled"), ("enabled", "disabled"), ("synchronous", "asynchronous"),
    ("blocking", "non blocking"), ("mutable", "immutable"), ("stateful", "stateless"), ("encrypted", "unencrypted"),
]
#: Scope and release status by word, and the profiles of claim and support that exclude each other.
SCOPES = {
    "universal": "all every global worldwide entire universal", "exclusive": "only exclusive solely",
    "limited": "selected some certain regional region varies subset specific",
}
SCOPE_CLASHES = [("universal", "limited"), ("universal", "exclusive"), ("exclusive", "limited")]
STATUSES = {"preview": "preview beta alpha experimental prelaunch", "available": "launched generally ga", "deprecated": "deprecated legacy retired sunset unsupported"}
STATUS_CLASHES = [("available", "preview"), ("preview", "available"), ("available", "deprecated"), ("preview", "deprecated")]
KOREAN_GLOSSES = {
    "제공": ["provides"], "지원": ["supports"], "인터페이스": ["interface"], "네트워크": ["network"], "요청": ["request", "fetching"], "리소스": ["resources"],
    "가져오": ["fetching"], "사용": ["used"], "문서": ["documentation"], "검색": ["search"], "추출": ["extract"], "세션": ["session"], "언어": ["language"],
    "컴파일": ["compiled"], "증거": ["evidence"], "근거": ["evidence"], "인터프리": ["interpreted"], "해석": ["interpreted"],
}
CHINESE_GLOSSES = {
    "提供": ["provides"], "支持": ["supports"], "接口": ["interface"], "网络": ["network"], "请求": ["request", "fetching"], "资源": ["resources"],
    "获取": ["fetching"], "抓取": ["fetching"], "文档": ["documentation"], "搜索": ["search"], "提取": ["extract"], "语言": ["language"], "编译": ["compiled"],
    "解释": ["interpreted"], "证据": ["evidence"], "依据": ["evidence"],
}
#: Score weights and adjustments by kind, role and region.
KIND_BONUS = {"table": 0.12, "list": 0.08, "text": 0.06, "heading": 0.03, "link": 0.03, "metadata": 0.02, "form": 0.08, "input": 0.06, "button": 0.01}
ROLE_ADJUSTMENT = {"content": 0.04, "supporting": 0.01, "metadata": -0.04, "primary-nav": -0.24, "secondary-nav": -0.24, "cta": -0.16, "form-control": -0.30, "table-cell": 0.05}
REGION_ADJUSTMENT = {"rmain:": 0.05, "rnav:": -0.18, "rfooter:": -0.16}
NUMERIC_NOISE = {"table": 0.22, "list": 0.16, "metadata": 0.10, "heading": 0.04}
SCORE_WEIGHTS = {"lexical": 0.40, "context": 0.26, "exact": 0.16, "numeric": 0.08, "gain": 0.10}
# --- end of fixed values ------------------------------------------------------------------------------------------
