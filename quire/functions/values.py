"""Fixed values that results depend on, and the classes of signs that patterns share."""

from __future__ import annotations

#: A word sign: letters, numbers and the underscore; combining marks are none.
W = r"[\p{L}\p{N}_]"
#: Nothing of a word before or after.
LEFT, RIGHT = rf"(?<!{W})", rf"(?!{W})"

# Words that content tokens leave out.
STOPWORDS = tuple(
    "và là của các có cho với trong được một những này đó khi để từ như không cũng đã sẽ "
    "rằng thì mà hay hoặc nên vì nếu tại theo về ra vào lên bởi còn rất nhiều "
    "the a an of and or to in on for with is are was were be been as by at from that this it its".split()
)

# Words that break a capitalised phrase.
PHRASE_STOP = tuple(
    "trong các những một để của và với cho khi nếu này đó bước phần kết quả tại thay chúng ta bạn hãy như theo "
    "mục chương hình bảng ví dụ lưu ý vì do thì mà cũng "
    "section fig figure table chapter exercises summary the a an".split()
)

# Single words that are no terms.
TERM_STOP = ("code", "design", "marketing", "review", "role", "event", "khung", "master", "owner", "demo", "minh")

# Terms that make no quiz answers.
QUIZ_STOP = (
    "trong", "các", "những", "một", "để", "của", "và", "với", "cho", "khi", "nếu", "này", "đó", "section", "fig", "figure",
    "table", "chapter", "bước", "phần", "kết quả", "ví dụ", "lưu ý", "code", "design", "review", "event", "role", "demo",
)

# Fixed value: letters with Vietnamese marks.
VI_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"

# Units of measure, and how some are spoken.
UNITS = ("%", "ms", "GB", "MB", "KB", "TB", "GHz", "MHz", "kHz", "Hz", "km", "cm", "mm", "kg", "°C", "px", "FLOPs?")
SPOKEN_UNITS = {
    "%": "phần trăm", "GB": "ghi ga bai", "MB": "mê ga bai", "KB": "ki lô bai", "TB": "tê ra bai", "GHz": "ghi ga héc",
    "MHz": "mê ga héc", "ms": "mi li giây", "°C": "độ xê", "px": "pích xeo",
}

# What makes a line a formula.
GREEK = "αβγδεζηθικλμνξοπρςστυφχψωΑΒΓΔΘΛΞΠΣΦΨΩ"
MATH = "∑∫√∂∇≈≠≤≥±×÷∈∉⊂⊆∪∩→←⇒∀∃∞·"
LATEX = ("frac", "sum", "int", "sqrt", "alpha", "beta", "gamma", "theta", "lambda", "sigma", "mathbf", "mathbb", "log", "exp", "partial", "nabla")

# What makes a line code. Statement words at its start; then attribute access, quotes, named arguments,
# indexing, assigned brackets, empty calls, powers.
CODE_WORDS = r"^\s*(?:import\b|from\s+\S+\s+import\b|def\b|class\b|for\b|while\b|if\b|elif\b|else\b|with\b|return\b|print\b|assert\b)"
CODE_MARKS = (
    r"\b[A-Za-z_]\w*\.[A-Za-z_]\w*",
    r"['\"]",
    r"[,(]\s*[A-Za-z_]\w*\s*=\s*[^=\s]",
    r"[A-Za-z_]\w*\[[^\]]*\]",
    r"=\s*[\[{]",
    r"\w\(\)",
    r"\*\*",
)

# Page numbers of a whole line: marked, a fraction, bare.
PAGE_MARKED = r"(?iu)^[\s\-–—•·\[\(<]*(?:trang|page|pg|tr|p)\.?\s*\d{1,4}(?:\s*(?:/|of|trên)\s*\d{1,4})?[\s\-–—•·\]\)>]*$"
PAGE_FRACTION = r"(?iu)^\s*\d{1,4}\s*(?:/|of|trên)\s*\d{1,4}\s*$"
PAGE_BARE = r"^[\s\-–—•·\[\(<]*\d{1,3}[\s\-–—•·\]\)>]*$"

# Reference-type headings after which an article extract ends.
CUT_SECTIONS = ("tham khảo", "liên kết ngoài", "xem thêm", "chú thích", "ghi chú", "đọc thêm", "thư mục")

# What an HTML page's text leaves out, and what ends a line.
SKIP_TAGS = ("script", "style", "nav", "header", "footer", "aside", "button", "noscript", "svg", "form")
SKIP_CLASS = r"sidebar|toc|navigation|nav-|navbar|related|footer|headerlink|menu|search"
BLOCK_TAGS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "pre", "tr", "section", "table")
VOID_TAGS = ("br", "img", "hr", "meta", "link", "input")
NOISE_LINE = r"^(copy to clipboard|mxnet|pytorch|tensorflow|jax|discussions?|¶)$"

# Folder names of a labelled corpus and their labels.
FOLDER_LABELS = {
    "machine_learning": "Machine Learning", "deep_learning": "Deep Learning", "nlp": "Natural Language Processing",
    "software": "Software Engineering & Web", "math": "Mathematics", "networks": "Computer Networks", "databases": "Databases",
    "os": "Operating Systems", "algorithms": "Algorithms & Data Structures", "security": "Information Security",
}

# Marks and limits of the model shell.
ERROR_PREFIX = "Lỗi khi gọi API Gemini"
SKIP_MARK = "[BỎ QUA]"
UNKNOWN, GENERAL = "Unknown", "General/Unknown"

# Messages about files.
OCR_WARNING = "Nội dung lấy bằng OCR (Gemini), công thức và ký hiệu có thể sai."
EMPTY_FILE, NO_TEXT = "File rỗng (0 byte).", "Không trích xuất được nội dung văn bản từ file này."
NO_ENCODING = "Không xác định được bảng mã của file .txt (thử lưu lại dưới dạng UTF-8)."
NO_OCR = "Cần bật OCR (Gemini) để đọc file ảnh."
UNSUPPORTED, NO_KIND = "Định dạng '{kind}' chưa được hỗ trợ. Hỗ trợ: {known}.", "(không có)"
UNREADABLE = "Không đọc được file {kind}. File có thể bị hỏng hoặc có mật khẩu. (Chi tiết: {why})"
PDF_PASSWORD = "PDF có mật khẩu. Hãy gỡ mật khẩu rồi tải lại."
PDF_NO_OCR = "PDF này gần như không có văn bản (có thể là bản scan) và OCR chưa được bật."
PDF_MANY_PAGES = "PDF scan có %d trang, chỉ OCR {most} trang đầu để tiết kiệm thời gian và quota."
MERGE_SKIPPED, MERGE_COPY = "Bỏ qua '%s': %s", "Bỏ qua '%s': nội dung trùng với '%s'."
MERGE_MANY, MERGE_NONE = "Tối đa {most} file mỗi lần (đang chọn %d).", "Không đọc được file nào. %s"
MERGE_HEADING, MERGE_TYPE = "Tài liệu %d: %s.", "Gộp %d file"

# Model and speech calls. A shorter text is returned as it is; part summaries are merged in groups while longer.
LEAST_CHARS, REDUCE_CHARS, MERGE_GROUP, MAP_CALLS, SPEECH_CALLS = 50, 20_000, 5, 2, 4

# What a lesson without a title is called.
LESSON = "Bài học"

# Collected articles. A shorter one is left out; the line below a title, and where an article's page is.
LEAST_WORDS = 300
SOURCE_LINE, ARTICLE_BASE = " — Wikipedia tiếng Việt (CC BY-SA 4.0)\n\n", "https://vi.wikipedia.org/wiki/"
