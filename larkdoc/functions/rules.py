"""Fixed values that results depend on: patterns, stop words, default numbers and texts.

Patterns are for Java's regex with ``(?iu)`` before them, so that case folds beyond ASCII.
"""

FALLBACK_ANSWER = "Không tìm thấy trong tài liệu"
TOP_K, MAX_TOP_K, MIN_OVERLAP, MIN_RELEVANT, MAX_ANSWER_CHARS, SENTENCE_SCORE, MAX_SENTENCES = 6, 20, 0.15, 1, 2500, 0.15, 5
CHUNK_SIZE, CHUNK_OVERLAP, HASH_DIMENSIONS = 1500, 200, 256
RATE_LIMITS = {"login": 20, "register": 10, "ask": 60, "upload": 30}
STALE_SECONDS, RETENTION_SECONDS, MAX_RETRIES, PENDING_SECONDS, MEMO_SECONDS = 120, 3600, 3, 900, 300
#: Least and greatest lengths of requests' fields.
FIELD_LENGTHS = {"title": (1, 200), "name": (1, 255), "username": (3, 64), "password": (8, 128)}
EXTENSIONS = (".txt", ".md", ".csv", ".json", ".xml", ".html", ".docx", ".xlsx", ".pptx", ".doc")

STOP_WORDS = (
    "va", "và", "la", "là", "cua", "của", "cho", "voi", "với", "trong", "tren", "trên", "duoc", "được", "nhung", "những", "cac", "các", "mot", "một",
    "nhu", "như", "the", "thế", "nao", "nào", "toi", "tôi", "ban", "bạn", "minh", "mình", "giup", "giúp", "gi", "gì", "co", "có", "khong", "không",
    "tai", "tại", "sao", "khi", "this", "that", "what", "when", "where", "who", "why", "how", "is", "are", "a", "an", "of", "for", "to", "and", "or",
    "in", "on", "from", "with", "about", "please", "help",
)

#: Titles and stand-ins of rendered outlines.
OVERVIEW, DEFAULT_ROOT, NO_DETAIL, NO_STAGE = "Tổng quan", "Tổng quan tài liệu", "Nội dung chính trong tài liệu", "Noi dung chinh"
TABLE_HEAD = "| Chủ đề | Điểm chính |\n|---|---|"
SUMMARY_HEAD, OVERVIEW_HEAD, DIAGRAM_HEAD = "### Tóm tắt nhanh", "### Bảng tổng hợp", "### Sơ đồ tổng quan"

COMPLEX = r"so\s*sánh|phân\s*tích|đánh\s*giá|chi\s*tiết|nguyên\s*nhân|hệ\s*quả|lộ\s*trình|kế\s*hoạch|why|how|compare|analysis|evaluate|risk|rủi\s*ro"
MINDMAP = r"tao\s*mindmap|tạo\s*mindmap|mind\s*map|so\s*do\s*tu\s*duy|sơ\s*đồ\s*tư\s*duy"
VISUAL = (
    r"tom\s*tat|tóm\s*tắt|tong\s*quan|tổng\s*quan|phan\s*tich|phân\s*tích|so\s*sanh|compare|liet\s*ke|liệt\s*kê|danh\s*gia|đánh\s*giá|"
    r"bang|bảng|chart|diagram|so\s*do|sơ\s*đồ|mindmap|truc\s*quan|trực\s*quan"
)
SIMPLE_FACT = (
    r"la\s*gi|là\s*gì|bao\s*nhieu|bao\s*nhiêu|khi\s*nao|ở\s*đâu|who|what|when|where|define|định\s*nghĩa|translate|dịch|"
    r"co\s*khong|có\s*không|yes\s*or\s*no"
)
TIMELINE = r"timeline|thoi\s*gian|thời\s*gian|lo\s*trinh|lộ\s*trình|tien\s*trinh|tiến\s*trình|qua\s*trinh|quá\s*trình|giai\s*doan|giai\s*đoạn"
PIE = r"ty\s*le|tỷ\s*lệ|phan\s*tram|phần\s*trăm|phan\s*bo|phân\s*bố|co\s*cau|cơ\s*cấu|pie"
FLOW = r"quy\s*trinh|quy\s*trình|luong|luồng|flow|process|buoc|bước"
SUMMARY = r"tóm tắt|tổng hợp|summarize|summary|overview|tổng quan|nội dung chính|main content|toàn bộ"
ALL_DOCUMENTS = r"\b(tat\s*ca|toan\s*bo|all\s*(documents?|docs?|files?|tai\s*lieu))\b"
DOCUMENT_NUMBER = r"\b(?:tai\s*lieu|document|doc|file)\s*(?:so|#|thu)?\s*(\d{1,3})\b"
BARE_NUMBER = r"\b(\d{1,3})\b"
ACROSS_DOCUMENTS = r"\b(trong\s*cac\s*tai\s*lieu|tai\s*lieu\s*nao|document\s*nao|among\s*documents?)\b"
SCOPE_SENSITIVE = (
    r"\b(tom\s*tat|summary|tong\s*quan|phan\s*tich|so\s*sanh|trich\s*xuat|mindmap|so\s*do|bieu\s*do|diagram|chart|giai\s*thich|dich|ket\s*luan|liet\s*ke|danh\s*gia)\b"
)
COMPARES_DOCUMENTS = r"\b(so\s*sanh|compare|doi\s*chieu|khac\s*biet|tuong\s*dong|giong\s*nhau|bang\s*so\s*sanh|tong\s*hop)\b"

#: (pattern, question to ask instead); the first that matches from the start of the question holds.
REWRITES = (
    (r"^(y\s*chinh|ý\s*chính|main\s*points?|key\s*points?)$", "Hãy nêu ý chính của toàn bộ tài liệu dưới dạng gạch đầu dòng ngắn gọn."),
    (r"^(day\s*la\s*loai\s*tai\s*lieu\s*gi|đây\s*là\s*loại\s*tài\s*liệu\s*gì|loai\s*tai\s*lieu\s*gi|loại\s*tài\s*liệu\s*gì)$", "Tài liệu này thuộc loại gì và chủ đề chính là gì?"),
    (r"^(trich\s*xuat\s*cac\s*dieu\s*khoan\s*chinh|trích\s*xuất\s*các\s*điều\s*khoản\s*chính)$", "Hãy trích xuất các điểm quan trọng chính trong tài liệu thành danh sách gạch đầu dòng."),
    (r"^(tao\s*bang\s*so\s*sanh|tạo\s*bảng\s*so\s*sánh|so\s*sanh\s*cac\s*so\s*lieu\s*quan\s*trong|so\s*sanh\s*các\s*số\s*liệu\s*quan\s*trọng)$", "Hãy tạo bảng so sánh bằng Markdown table chuẩn (header rõ ràng), không dùng bảng ASCII text."),
    (r"^(tom\s*tat|tóm\s*tắt|summarize|summary|overview|tong\s*quan|tổng\s*quan)$", "Hãy tóm tắt toàn bộ nội dung tài liệu một cách ngắn gọn, đầy đủ các ý chính."),
    (r"^(ket\s*luan|kết\s*luận|conclusion)$", "Hãy nêu kết luận hoặc phần kết thúc của tài liệu."),
    (r"^(dinh\s*nghia|định\s*nghĩa|define|definition)[\s:]*(.+)$", "Hãy tìm và giải thích định nghĩa của khái niệm được đề cập trong tài liệu."),
    (r"^(liet\s*ke|liệt\s*kê|list\s*all|danh\s*sach|danh\s*sách)[\s:]*(.*)$", "Hãy liệt kê tất cả các mục, danh sách hoặc thông tin quan trọng có trong tài liệu."),
    (r"^(giai\s*thich|giải\s*thích|explain)[\s:]*(.+)$", "Hãy giải thích chi tiết nội dung được hỏi dựa trên tài liệu."),
    (r"^(so\s*lieu|số\s*liệu|statistics?|data|du\s*lieu|dữ\s*liệu)$", "Hãy trích xuất các số liệu, dữ liệu và thống kê quan trọng có trong tài liệu."),
    (r"(uu\s*va\s*nhuoc\s*diem|ưu\s*và\s*nhược\s*điểm|pros?\s*and\s*cons?|advantages?\s*and\s*disadvantages?)", "Hãy phân tích ưu điểm và nhược điểm của nội dung trong tài liệu, trình bày dưới dạng bảng hoặc danh sách rõ ràng."),
    (r"(diem\s*(gi\s*)?noi\s*bat|điểm\s*(gì\s*)?nổi\s*bật|highlight|outstanding|noi\s*troi|nổi\s*trội)", "Hãy nêu những điểm nổi bật, đặc biệt hoặc khác biệt của tài liệu này so với các tài liệu cùng chủ đề."),
    (r"(gia\s*dinh|giả\s*định|thien\s*kien|thiên\s*kiến|bias|assumption)", "Hãy phân tích xem tài liệu có chứa giả định, thiên kiến (bias) hoặc quan điểm một chiều nào không. Nêu cụ thể."),
    (r"(phan\s*nao\s*(la\s*)?quan\s*trong\s*nhat|phần\s*nào\s*(là\s*)?quan\s*trọng\s*nhất|most\s*important\s*part)", "Hãy xác định phần nào trong tài liệu là quan trọng nhất và giải thích lý do tại sao."),
    (r"(tao\s*mindmap|tạo\s*mindmap|mind\s*map|so\s*do\s*tu\s*duy|sơ\s*đồ\s*tư\s*duy)", "Hãy tạo sơ đồ tư duy bằng Mermaid với cú pháp mindmap trong khối ```mermaid``` (không dùng graph/flowchart), có ít nhất 4 nhánh cấp 1 và mỗi nhánh có 2-4 nhánh con, tránh chuỗi tuyến tính một hàng."),
    (r"(bieu\s*do|biểu\s*đồ|do\s*thi|đồ\s*thị|chart|graph|plot|diagram|so\s*do\s*luong|sơ\s*đồ\s*luồng|flow\s*chart)", "Hãy tạo biểu đồ/sơ đồ trực quan bằng Mermaid trong khối ```mermaid``` (chọn loại phù hợp như flowchart, pie, timeline hoặc xychart), rồi giải thích ngắn 3-5 gạch đầu dòng."),
    (r"(cau\s*hoi\s*trac\s*nghiem|câu\s*hỏi\s*trắc\s*nghiệm|quiz|multiple\s*choice|trac\s*nghiem|trắc\s*nghiệm)", "Hãy tạo 5-10 câu hỏi trắc nghiệm (4 đáp án A/B/C/D) từ nội dung tài liệu, kèm đáp án đúng và giải thích ngắn."),
    (r"(giai\s*thich\s*nhu\s*cho\s*nguoi\s*moi|giải\s*thích\s*như\s*cho\s*người\s*mới|beginner|explain\s*simply|don\s*gian\s*hoa|đơn\s*giản\s*hóa|eli5)", "Hãy giải thích nội dung tài liệu bằng ngôn ngữ đơn giản, dễ hiểu, như đang giải thích cho người mới bắt đầu."),
    (r"(cho\s*vi\s*du\s*thuc\s*te|cho\s*ví\s*dụ\s*thực\s*tế|real\s*world\s*example|vi\s*du\s*minh\s*hoa|ví\s*dụ\s*minh\s*họa|practical\s*example)", "Hãy cho các ví dụ thực tế, cụ thể liên quan đến nội dung trong tài liệu để dễ hiểu hơn."),
    (r"(viet\s*lai.*ngan\s*gon|viết\s*lại.*ngắn\s*gọn|shorten|make\s*it\s*shorter|rut\s*gon|rút\s*gọn)", "Hãy viết lại nội dung tài liệu một cách ngắn gọn hơn, giữ lại các ý chính quan trọng nhất."),
    (r"(chuyen.*slide|chuyển.*slide|presentation|thuyet\s*trinh|thuyết\s*trình|lam\s*slide|làm\s*slide)", "Hãy chuyển nội dung tài liệu thành dạng slide thuyết trình, mỗi slide gồm tiêu đề và 3-5 bullet points ngắn gọn."),
    (r"(dich.*sang\s*tieng\s*anh|dịch.*sang\s*tiếng\s*anh|translate.*english)", "Hãy dịch nội dung chính của tài liệu sang tiếng Anh, giữ nguyên ý nghĩa và cấu trúc."),
    (r"(dich.*sang\s*tieng\s*viet|dịch.*sang\s*tiếng\s*việt|translate.*vietnamese)", "Hãy dịch nội dung chính của tài liệu sang tiếng Việt, giữ nguyên ý nghĩa và cấu trúc."),
    (r"(van\s*phong\s*hoc\s*thuat|văn\s*phong\s*học\s*thuật|academic\s*style|hoc\s*thuat\s*hoa|học\s*thuật\s*hóa)", "Hãy viết lại nội dung tài liệu theo văn phong học thuật, chính thống, phù hợp cho bài nghiên cứu hoặc báo cáo."),
    (r"(ap\s*dung.*du\s*an|áp\s*dụng.*dự\s*án|apply.*project|ung\s*dung\s*vao|ứng\s*dụng\s*vào)", "Dựa trên nội dung tài liệu, hãy gợi ý cách áp dụng kiến thức này vào một dự án thực tế, kèm ví dụ cụ thể."),
    (r"(dung.*trong\s*lap\s*trinh|dùng.*trong\s*lập\s*trình|use.*programming|code\s*example|ap\s*dung.*lap\s*trinh|áp\s*dụng.*lập\s*trình)", "Hãy chỉ ra cách áp dụng nội dung tài liệu trong lập trình, kèm code minh họa nếu có thể."),
    (r"(case\s*study|tinh\s*huong\s*thuc\s*te|tình\s*huống\s*thực\s*tế|bai\s*hoc\s*thuc\s*te|bài\s*học\s*thực\s*tế)", "Hãy đưa ra một case study hoặc tình huống thực tế liên quan đến nội dung tài liệu để minh họa."),
    (r"(giai\s*quyet\s*van\s*de\s*gi|giải\s*quyết\s*vấn\s*đề\s*gì|solve\s*what\s*problem|giup\s*gi|giúp\s*gì|useful\s*for)", "Tài liệu này giúp giải quyết vấn đề gì? Hãy nêu các vấn đề cụ thể và cách tài liệu đưa ra giải pháp."),
    (r"(dang\s*tin\s*khong|đáng\s*tin\s*không|credible|trustworthy|do\s*tin\s*cay|độ\s*tin\s*cậy|reliable)", "Hãy đánh giá độ tin cậy của thông tin trong tài liệu: nguồn dữ liệu có rõ ràng không, có trích dẫn không, có cập nhật không?"),
    (r"(nguon.*uy\s*tin|nguồn.*uy\s*tín|reputable\s*source|reliable\s*source)", "Hãy đánh giá xem nguồn tài liệu này có uy tín không, dựa trên tác giả, tổ chức, năm xuất bản và chất lượng nội dung."),
    (r"(loi\s*logic|lỗi\s*logic|sai\s*sot|sai\s*sót|logical?\s*error|mistake|inconsistenc)", "Hãy kiểm tra tài liệu xem có lỗi logic, mâu thuẫn, hoặc sai sót nào trong nội dung không. Nêu cụ thể nếu có."),
    (r"(so\s*sanh\s*voi\s*tai\s*lieu\s*khac|so\s*sánh\s*với\s*tài\s*liệu\s*khác|compare\s*with\s*other)", "Hãy phân tích và nêu những điểm mà tài liệu này có thể khác biệt hoặc bổ sung so với các tài liệu cùng chủ đề."),
)
