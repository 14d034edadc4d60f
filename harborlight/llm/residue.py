"""Problem 10: template residue, filler, error pages and script notices in place of real content."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut_lineage, table


_CUT = "\U0010ffff"  # no character; stands between texts


def _plain(c: str) -> int:
    """A character in lower case without its marks, 0 for one that goes; kana and Thai signs keep theirs."""
    if "\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u30ff":
        return ord(c)
    if c in "\r\u2028\u2029\x85\x0b\x0c":
        return 10
    plain = [x for x in unicodedata.normalize("NFD", c.casefold()) if unicodedata.category(x) not in ("Mn", "Cf")]
    composed = unicodedata.normalize("NFC", "".join(plain))[:1].replace("đ", "d")
    return ord(composed) if composed else 0


@cache
def _fold_table() -> np.ndarray:
    """By code point; beyond the alphabets (from U+3000 on) characters stay as they are, but for variation selectors and tags."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[:0x3100] = [_plain(chr(c)) for c in range(0x3100)]
    table[0xFE00:0xFE10] = table[0xFEFF] = 0
    table[0xE0000:0xE01F0] = 0
    return table


_GAP = re.compile(r"[^\S\n]{2,}|[^\S\n ]")


def fold_all(texts: Sequence[str]) -> list[str]:
    """Width, case and marks folded away, white space within a line as one space; line ends stay."""
    if not texts:
        return []
    codes = np.frombuffer(_CUT.join(unicodedata.normalize("NFKC", t).replace("\r\n", "\n") for t in texts).encode("utf-32-le"), "<u4")
    plain = _fold_table()[codes]
    return _GAP.sub(" ", plain[plain != 0].tobytes().decode("utf-32-le")).split(_CUT)


def fold(text: str) -> str:
    """``fold_all`` of one text."""
    return fold_all([text.replace(_CUT, "")])[0]


_NAME = r"[a-z_][a-z0-9_.]*"
#: Raw tags of template languages, on text with its case and marks. Each holds a name, a number or nothing.
_TAGS = [
    r"\{\{+\s*[#/^&>!]?\s*[\w.|}]",
    rf"\{{\s*(?:\d+|{_NAME}\??)\s*\}}",
    r"[$#]\{[^{}\n]{0,60}\}",
    rf"<%[=-]?[^%\n]{{0,60}}%>|\{{%[^%\n]{{0,60}}%\}}|<!--\s*{_NAME}\s*-->",
    rf"(?<![\w%])%(?:\d+\$)?[sd](?![\w%])|%\({_NAME}\)[sd]",
    r"%%[a-z_.]+%%|(?<![\w%])%[a-z_.]{3,}%(?![\w%])|\[%\s*[a-z_.]+\s*%\]",
    rf"\[\[\s*{_NAME}\s*\]\]|@@\s*{_NAME}\s*@@|«{_NAME}»",
    r"\$[a-z_][a-z_.]*\$",
    r"(?<![\w:]):[a-z_][a-z_.]*:(?![\w:])",
    r"__[a-z][a-z0-9_.]*?__(?!\w)",
    rf"<{_NAME}>",
    r"[<\[](?:insert|enter|your|chèn|điền|nhập|tên|chen|dien|nhap|ten)\s[^<>\[\]\n]{1,40}[>\]]",
    r"\((?:insert|fill in|chèn|điền|(?:nhập|nhap)(?= (?:mô tả|tên|giá|địa chỉ|nội dung|tại đây))|chen|dien)\s[^()\n]{1,40}\)",
    r"…+ ?\([^()\n]{1,40}\) ?…+|\.{3,} ?\([^()\n]{1,40}\) ?\.{3,}",
    r"\[[■□▪▢█?…]{2,}\]",
    r"\[object object\]",
    rf"<<\s*{_NAME}\s*>>|\{{\$[a-z_.]+\}}|<\?(?:=|php)[^>\n]{{0,60}}\?>|(?<!\w)@[a-z_.]+@(?!\w)|\[[a-z]+(?:_[a-z]+)+\]",
    r"#(?:name\?|ref!|value!|n/a|div/0!)|(?<!\w)invalid date(?!\w)",
    r"(?<!\w)tbd(?:_\w+)?(?!\w)",
    r"(?<![\w-])x{4,}(?![\w-])",
]
TAG = re.compile("|".join(_TAGS), re.I)
_SIGN = ("{", "<", "[", "%", "@", "«", "$", "#", "__", "tbd", "xxxx", "invalid date", "(insert", "(enter", "(fill in", "(chèn", "(chen", "(điền", "(dien", "(nhập", "(nhap")
# Words that name a field of a template, folded.
FIELDS = frozenset("name hotel property room guest customer client city address price rate date phone email number company amount title link url first last full check in out ten khach san phong gia thanh pho dia chi ngay so dien thoai nguoi dat ho nom nombre nome stadt preis precio adresse direccion".split())
_BRACKET = re.compile(r"\[([^\[\]\n]{2,40})\]|\{([^{}\n]{2,40})\}|<([^<>\n]{2,40})>")
#: Markup and control strings of other software, which may stand in real content.
_MARKUP = re.compile(r"<(?:s|unk|pad|mask|cls|sep|bos|eos|a|b|i|u|p|br|hr|em|li|ol|ul|td|th|tr|h[1-6]|div|img|pre|sub|sup|span|code|strong|table|body|html|head|error|message|requestid)>", re.I)
#: Words after which a sign in brackets is a name that is told, not a slot to fill.
_NAMING = re.compile(r"(?:\b(?:titled|named|called|labell?ed|said|says|reads|written|spelled|marked)|\btên là|\bten la|mặt cười|mat cuoi|smiley|emoji|\bgọi là|\bgoi la|\bin chữ|\bin chu|\bđề chữ|\bviết là|\bviet la)\s*[:\"“']?\s*$", re.I)
#: A program's empty value where a word should stand; case counts unless the whole text has one case.
_EMPTY = re.compile(
    r"(?<![\w-])(?:undefined|UNDEFINED|Undefined|null|NULL|NaN|TODO)(?![\w-])|(?<![\w-])None(?![\w-])(?! (?:of|were|was|are|is|the|have|had|can|could|will|would)\b)"
)
_EMPTY_LOWER = re.compile(r"(?<![\w-])(?:undefined|null|nan(?! (?:tre|hoa|quạt|quat))|none(?! (?:of|were|was|are|is|the|have|had|can|could|will|would)\b))(?![\w-])")
_TODO_LOWER = re.compile(r"(?<![\w-])todo(?![\w-])(?! (?:el|o|lo|los|las|un|mundo|tipo|dia|día)\b)")
_SAID = re.compile(r"[\"”’»]?\s*(?:(?:là|la) (?:chữ|chu|tên|ten)\\b|(?:is|was|are) (?:painted|written|printed|carved|spelled)|(?:painted|printed|carved) )", re.I)
_TOLD = re.compile(r"(?:\b(?:almost|loosely|is|are|was|were|be|left|remains?|rather|quite|somewhat|still|largely)|\bgần như)\s+$", re.I)
_ROMANCE = re.compile(r"\b(?:el|los|para|habitación|cada|os|uma|não|desayuno|quarto)\b", re.I)


def _field(inside: str) -> bool:
    """Whether what stands in brackets is nothing but the name of a field, of two words or more or in capitals."""
    words = re.findall(r"[^\W_]+", fold(inside))
    return bool(words) and all(w in FIELDS for w in words) and (len(words) > 1 or inside.isupper())


def has_slot(text: str) -> bool:
    """Whether a tag that a template should have filled is left raw or came out as a program's empty value."""
    low = text.lower()
    if any(w in low for w in _SIGN) or low.count(":") > 1 or ("(" in low and ("…" in low or "..." in low)):
        told = lambda m: _NAMING.search(text[max(0, m.start() - 24) : m.start()]) or _SAID.match(text[m.end() : m.end() + 24])
        if any(not _MARKUP.fullmatch(m.group()) and not told(m) for m in TAG.finditer(text)):
            return True
        if any(_field(next(filter(None, m.groups()))) and not _MARKUP.fullmatch(m.group()) and not told(m) for m in _BRACKET.finditer(text)):
            return True
    if text == low or text == text.upper():
        if any(w in low for w in ("undefined", "null", "nan", "none")):
            for m in _EMPTY_LOWER.finditer(low):
                if not _TOLD.search(low[max(0, m.start() - 16) : m.start()]) and not re.match(r" (?:and void|uhr|problem)", low[m.end() :]):
                    return True
        return "todo" in low and bool(_TODO_LOWER.search(low)) and not _ROMANCE.search(low)
    if any(w in text for w in ("ndefined", "UNDEFINED", "null", "NULL", "NaN", "TODO", "None")):
        for m in _EMPTY.finditer(text):
            if not _TOLD.search(text[max(0, m.start() - 16) : m.start()]) and not re.match(r" (?:and void|Uhr|Problem)", text[m.end() :]):
                return True
    return False


# Stems of what error, blocked and maintenance pages, script notices and filler are about, in the languages of
# the corpus. A text without any of them carries no evidence.
STEMS = {
    "error": """not found|be found|unable to|n't working|n’t working|not working|404|403|502|503|504|no longer available|no longer exist|does not exist|doesn't exist|doesn’t exist|server error|bad gateway|gateway time|unavailable|forbidden|denied|unauthorized|not authorized|permission to|maintenance|be back|went wrong|error|exception|traceback
        fatal|too many requests|rate limit|timed out|time out|timeout|could not|cannot connect|connection refused|can't be reached|can’t be reached|are human|a robot|captcha|checking your browser|security check|been blocked|is blocked|has expired|session expired|bad request|under construction|request failed|unable to load|failed to load
        khong tim thay|khong ton tai|loi he thong|loi may chu|loi ket noi|xay ra loi|gap loi|bao loi|loi 4|loi 5|ma loi|co loi|may chu|bao tri|nang cap|tu choi|quyen xem|quyen truy cap|bi chan|het han|qua tai|khong kha dung|tam ngung|khong the truy cap|khong the ket noi|xac minh|kiem tra trinh duyet|kiem tra ket noi|qua nhieu yeu cau
        introuvable|erreur|indisponible|refuse|interdit|n'existe|n’existe|expire|nicht gefunden|fehler|nicht verfugbar|wartung|verweigert|existiert nicht|abgelaufen|nicht erreichbar|no encontrad|no se encontr|no existe|mantenimiento|denegado|prohibido|no disponible|caducado|nao encontrad|nao existe|erro|manutencao|negado|indisponivel|expirou
        tidak ditemukan|tidak ada|kesalahan|tidak tersedia|pemeliharaan|ditolak|kedaluwarsa|не найден|ошибка|недоступ|запрещ|обслуживан|технические работы|не существует|истекл|찾을 수 없|오류|에러|점검|권한|만료|존재하지|거부|見つかりません|エラー|メンテナンス|存在しません|利用できません|拒否|アクセスできません|不存在|未找到|找不到|错误|出错|维护|拒绝|无法访问|无法显示|过期|ไม่พบ|ข้อผิดพลาด|ปรับปรุง|ปฏิเสธ|หมดอายุ""",
    "script": "javascript|java script|script|js|tap lenh|скрипт|자바스크립트|스크립트|スクリプト|脚本|สคริปต์",
    "filler": """lorem|ipsum|dolor|consectetur|donec|mauris|purus|lacus|augue|felis|vitae|tempor|eiusmod|nostrud|ullamco|placeholder|dummy|filler|sample|goes here|text here|content here|coming soon|to be added|to be announced|click to edit|edit this|your text|add your|insert your|enter your|type your|description here|van ban mau|noi dung mau|doan mau|doan van ban|noi dung tai day|noi dung o day|cap nhat|bo sung|giu cho|giu bo cuc
        mo ta tai day|mo ta o day|nhap mo ta|nhap noi dung|vi du noi dung|noi dung thu|relleno|texto de|texto aqui|conteudo aqui|beispieltext|blindtext|platzhalter|mustertext|faux texte|texte d'exemple|texte factice|texte ici|teks contoh|isi teks|пример текста|заглушка|здесь будет|текст здесь|예시|샘플|여기에|ダミー|サンプル|ここに|示例|占位|此处|测试|ตัวอย่าง|asdf|qwer|xyz|aaa|mo ta mo ta|text text|test test|bla bla|blah""",
}
# Words that such notices are made of, folded, by language.
WORDS = frozenset(
    """a an the this that these those your you we our us it its is are was were be been being has have had do does did not no or and but to of on in at by for from with as if when while after before please sorry oops whoops looks like right what who why how there here then now again later soon back home more can cannot can't could couldn't complete completed may might must will would should need needs requires required require
    page pages site website web url link address server servers request requested requests response error errors code status http https found unavailable available temporarily temporary permanently moved removed deleted exist exists access denied forbidden permission authorized unauthorized login log sign in out up user account administrator admin webmaster support contact help team problem issue issues something wrong went happened occurred
    unexpected unknown internal bad gateway timeout time timed upstream service down maintenance scheduled undergoing under construction updating back shortly try trying retry refresh reload return go going search looking view show display load loading loaded unable failed fail connect connection connecting database network too many limit exceeded rate seconds minutes few moment wait blocked security check checking browser verify verifying verification human robot
    captcha ip ray id reference requestid trace message session expired expire javascript java script scripts establishing establish enable enabled enabling disabled turn allow activate continue run app application work works working properly without full experience cookies cookie content features settings support supported proceed fatal exception warning notice invalid working isn't isn’t don't don’t doesn't doesn’t won't wasn't nginx apache cloudflare
    lorem ipsum text sample dummy placeholder filler copy paragraph layout replace replaced before launch example template description title heading goes write add insert edit enter type coming added announced published tuned soon test testing abc xyz asdf qwerty foo bar blah bla
    trang ban tim ho tro khong ton tai hoac da bi go xoa loi thay yeu cau phien lam viec het han vui long dang nhap lai he thong bao tri moi quy khach quay sau co quyen xem muc nay ma kiem tra ket noi cua truoc khi tiep tuc bat javascript de noi dung hay mo cho phep script trinh duyet tat tap lenh nen the hien thi can js hoat dong cai dat su dung ung dung
    duong dan lien web website may chu nang cap tam thoi gian doan ngung phuc vu it phut thu tu choi truy cap chan xac minh nguoi dung qua nhieu tai du lieu xay ra su co xin rat tiec chu ve toi nhung duoc dc se la va voi trong mot cac nhu o tu ko k
    van ban mau doan thay vi du nhap chen giu cho bo cuc mo ta tai day cap nhat bo sung them gia
    cette la le les l un une page est introuvable pas n ou existe plus erreur du de des serveur service indisponible momentanement acces refuse interdit site en cours maintenance veuillez activer javascript scripts votre navigateur pour continuer afficher ce contenu reessayer plus tard session expiree vous avez ete demandee demande texte exemple faux factice remplacer ici
    die der das dieser diese seite wurde nicht gefunden existiert mehr fehler serverfehler server intern interner interne dienst vorubergehend verfugbar wartung wartungsarbeiten zugriff verweigert bitte aktivieren sie javascript skripte in ihrem browser um anzuzeigen anzeigen fortzufahren spater erneut versuchen sitzung abgelaufen angeforderte ist sind wird im fur beispieltext platzhalter blindtext mustertext hier text
    el los las esta pagina no encontrada encontrado se ha encontrar existe ya error del servidor interno servicio disponible temporalmente mantenimiento acceso denegado prohibido por favor active activar activa javascript su tu navegador para ver contenido continuar intentelo nuevo mas tarde sesion caducada expirado solicitada que y es texto relleno maqueta ejemplo aqui prueba
    o os as esta sitio pagina em nao encontrada foi encontrado erro do servidor servico indisponivel manutencao acesso negado ative habilite seu navegador para conteudo tente novamente mais tarde sessao expirou solicitada exemplo texto aqui
    halaman yang anda cari tidak ditemukan ada kesalahan pada server layanan tersedia sedang dalam pemeliharaan akses ditolak silakan aktifkan javascript di peramban untuk melanjutkan melihat konten ini coba lagi nanti sesi kedaluwarsa telah berakhir dihapus atau contoh teks isi sini
    страница сайт не найдена существует ошибка сервера внутренняя сервис временно недоступен недоступна доступ запрещен ведутся технические работы техническом обслуживании обслуживание включите javascript скрипты в вашем браузере чтобы продолжить для просмотра повторите попытку позже сессия истекла запрошенная к сожалению эта на и или пример текста здесь будет текст заглушка""".split()
)
WORDS = WORDS | {fold(w) for w in WORDS}
# The same for scripts without white space between words.
SIGNS = """页面|网页|页|网站|不存在|或|已|被|删除|移除|找不到|未找到|无法|访问|显示|打开|请|您|的|请求|服务器|内部|错误|出错|了|稍后|后|再|试|重试|维护|中|正在|系统|暂时|不可用|拒绝|权限|没有|登录|过期|会话|验证|浏览器|启用|开启|脚本|本|此|该|需要|支持|才能|使用|内容|示例|文本|占位|测试|输入|抱歉|对不起|返回|首页|代码|网络|连接|超时|处|放|文字
    ページ|お探し|見つかりません|見つかり|ません|が|の|は|を|に|で|と|も|し|ます|ました|ください|有効|スクリプト|エラー|発生|サーバー|内部|メンテナンス|現在|アクセス|拒否|され|できません|できない|権限|ありません|後|ほど|もう一度|お試し|存在|しません|削除|た|て|です|可能性|ブラウザ|設定|セッション|期限|切れ|ログイン|ダミー|テキスト|サンプル|ここ|入力|準備|タイムアウト|接続|利用|申し訳ございません|表示|要求|する|必要|文章
    페이지|요청|하신|찾을|수|없습니다|없음|자바스크립트|스크립트|켜야|볼|있습니다|활성화|해|주세요|주십시오|브라우저|오류|에러|발생|했습니다|서버|점검|중|입니다|접근|접속|권한|거부|만료|세션|다시|시도|로그인|잠시|후|존재하지|않습니다|않는|삭제|되었|습니다|이용|콘텐츠|내용|예시|샘플|텍스트|여기에|입력|준비|차단|확인|연결|시간|초과|죄송합니다|사이트|이|가|을|를|은|는|의|에|하려면|보려면|거나
    ไม่พบ|ไม่มี|ไม่สามารถ|ไม่|พบ|หน้า|ที่|คุณ|ต้องการ|ค้นหา|ข้อผิดพลาด|เกิด|เซิร์ฟเวอร์|ภายใน|กรุณา|โปรด|เปิด|ใช้งาน|จาวาสคริปต์|สคริปต์|เบราว์เซอร์|ของ|เพื่อ|ดู|เนื้อหา|นี้|ปิด|ปรับปรุง|ระบบ|ลอง|ใหม่|อีก|ครั้ง|ภายหลัง|สิทธิ์|เข้าถึง|ปฏิเสธ|ถูก|หมดอายุ|เซสชัน|ข้อความ|ตัวอย่าง|อยู่|หรือ|ลบ|แล้ว|ขออภัย|เว็บไซต์"""
# Words of the usual filler text, and what is typed to fill a field.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum justo porta purus mauris massa erat augue felis donec cras arcu lacus vitae nunc pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum ante primis faucibus".split()
    + "abc aaa asdf asd qwer qwerty zxcv xyz xxx test foo bar".split()
)

_STEM = ahocorasick.Automaton()
for _kind, _stems in STEMS.items():
    for _stem in _stems.replace("\n", "|").split("|"):
        if _stem.strip():
            _STEM.add_word(fold(_stem.strip()), _kind)
_STEM.make_automaton()
_SIGNS = re.compile("|".join(sorted({re.escape(fold(w.strip())) for w in SIGNS.replace("\n", "|").split("|")}, key=len, reverse=True)))
_UNSPACED = re.compile(r"[฀-๿ᄀ-ᇿ぀-ヿ㐀-鿿가-힣]+")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CODE = re.compile(r"(?=[^\W_]*\d)[0-9a-z]+")
_UNIT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\s+[|–—-]\s+")
#: What machines say: bodies of failed requests, traces, errors by their class.
_MACHINE = re.compile(r"^[\[{<].*\b(?:error|exception|fault|denied|code|status)s?\b.*[\]}>]$|^traceback \(|^file \"[^\"]+\", line \d+|^at [\w.$<>]+\(|\b[a-z_.]*(?:error|exception)\b\s*(?::|$| in | at )|^(?:php )?(?:fatal|warning|notice)\b.*(?:/|\(\)|:)")


def evidence(t: str) -> bool:
    """Whether a folded text has any stem of an error, script or filler notice."""
    return next(_STEM.iter(t), None) is not None


def coverage(t: str) -> float:
    """The share of a folded text's words that notices are made of. Numbers and codes don't count, signs of scripts without
    white space count by three as a word."""
    rest, seen = _UNSPACED.sub(" ", t), _UNSPACED.findall(t)
    signs = sum(map(len, seen))
    known = sum(len(m) for s in seen for m in _SIGNS.findall(s))
    words = [w for w in _TOKEN.findall(rest) if not _CODE.fullmatch(w)]
    total = len(words) + signs / 3
    return (sum(w in WORDS or all(x in WORDS for x in re.split("['’]", w)) for w in words) + known / 3) / total if total else 0.0


def is_filler(t: str) -> bool:
    """Whether a folded text is made of the usual filler words, or of one or two words said again and again."""
    words = _TOKEN.findall(t)
    return len(words) >= 2 and (sum(w in LOREM for w in words) >= 0.6 * len(words) or (len(words) >= 3 and len(set(words)) <= len(words) / 3 + 1 and all(w in WORDS for w in words)))


def is_notice(t: str, least: float = 0.81) -> bool:
    """Whether a folded sentence carries evidence and is made of a notice's words alone, but for a fifth of them."""
    return is_filler(t) or (evidence(t) and coverage(t) >= least) or _MACHINE.search(t.strip()) is not None or re.fullmatch(r"\W*[45]\d\d\W*", t) is not None


_ENDS = " .!…:)(-–—|"
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_DIGITS = re.compile(r"\d+")


def _numberless(line: str) -> str:
    return _DIGITS.sub("#", _HEX.sub("#", line)) if _DIGITS.search(line) else line


def normal_line(line: str) -> str:
    """A folded line with numbers and codes replaced, so that repetitions of one template meet."""
    return _numberless(line.strip(_ENDS))


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


#: Words of a line up to which a run of them is looked up as boilerplate; whole lines are, at any length.
LONGEST_RUN = 16


def residual(line: str, known) -> Iterator[str]:
    """What is left of a folded line, from left to right, without the longest runs of words that are boilerplate, cut at
    sentence ends, which may lie within a word where a script has no white space. What else is in ``known`` doesn't matter."""
    ends, start = [m.end() for m in _UNIT.finditer(line)] + [len(line)], 0
    words = [m.span() for m in re.finditer(r"\S+", line)] if known else []
    plain = [_numberless(line[a:b]) for a, b in words]
    i = 0
    while i < len(words):
        while words[i][0] >= ends[0]:
            if ends[0] > start:
                yield line[start : ends[0]]
                start = ends[0]
            ends.pop(0)
        for j in range(min(len(words), i + LONGEST_RUN), i, -1):
            if _hash(" ".join(plain[i:j]).strip(_ENDS)) in known:
                yield line[start : words[i][0]]
                start, i = words[j - 1][1], j
                break
        else:
            i += 1
    for end in ends:
        if end > start:
            yield line[start:end]
            start = end


def is_page(t: str, known, learned=frozenset()) -> bool:
    """Whether nothing but notices is left of a folded text, and at least one, once its title line and boilerplate are out.

    ``known`` are hashes of the boilerplate lines of its host, ``learned`` those of lines with evidence that whole records of
    any host consist of, which pass with fewer of a notice's words. A sentence of such words alone is no content either. The
    first sentence of content ends the search, so real texts cost little.
    """
    lines, found = [x for x in t.split("\n") if x.strip()], False
    for k, line in enumerate(lines):
        title = len(line) <= 120 and not re.search(r"[.!?…。！？:]\s*$", line)
        whole = _hash(normal_line(line))
        if whole in known or (k == 0 and title and len(lines) > 1 and not evidence(line)):
            continue
        if is_notice(line) or (whole in learned and coverage(line) >= 0.4):
            found = True
            continue
        here, headings = False, 0
        for unit in residual(line, known if evidence(line) else ()):
            if not _TOKEN.search(unit):
                continue
            if is_notice(unit):
                here = True
            elif coverage(unit) < 0.95:
                headings += 1
                if not title or len(unit.split()) > 6:
                    return False
        if headings and not here:
            return False
        found = found or here
    return found


_SCAN = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("slot", pa.bool_()), ("page", pa.bool_()), ("rest", pa.string()), ("lines", pa.list_(pa.int64())), ("own", pa.list_(pa.bool_()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            part = batch.slice(start, 2_000)
            rows = []
            columns = [part.column(i).to_pylist() for i in range(3)]
            texts = [t.replace(_CUT, "") for t in columns[2]]
            for key, host, text, t in zip(*columns, fold_all(texts)):
                page = evidence(t) or re.fullmatch(r"\W*[45]\d\d\W*", t) is not None
                own = {_hash(k): page and evidence(line) for line in t.split("\n") if (k := normal_line(line))}
                rows.append((key, host, has_slot(text), page, t if page else None, [*own], [*own.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN)], schema=_SCAN)


def _judge(known: dict[str, frozenset[int]] | None, learned: frozenset[int]):
    """Keeps the pages; boilerplate is looked up by host and learned lines in all, or, where there are too many, those that a
    record has come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            if known is not None:
                keep = [key for key, host, t in zip(*columns) if is_page(t, known.get(host, ()), learned)]
            else:
                keep = [key for key, _, t, own, said in zip(*columns) if is_page(t, set(own or ()), set(said or ()))]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], names=["doc_id"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, host, line) of every line and run of words that boilerplate could take out."""
    for batch in batches:
        for key, host, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            seen: set[int] = set()
            for line in t.split("\n"):
                seen.add(_hash(normal_line(line)))
                plain = [_numberless(w) for w in line.split()] if evidence(line) else []
                seen |= {_hash(" ".join(plain[i:j]).strip(_ENDS)) for i in range(len(plain)) for j in range(i + 1, min(len(plain), i + LONGEST_RUN) + 1)}
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(seen), pa.int64()), pa.array([host] * len(seen), pa.string()), pa.array([*seen], pa.int64())], names=["doc_id", "host", "line"])


#: Boilerplate lines up to which they go with the code (16 bytes each); beyond it, they are joined, with the same result.
MOST_KNOWN = 200_000


def find_residue(df: DataFrame, key: str, host: str, text: str, recurrent: int = 3, share: float = 0.5) -> DataFrame:
    """(doc_id, reason) of the records without real content: 'template' or 'page'.

    Normalised lines are counted by host over all records. A line without evidence of its own is boilerplate if
    ``recurrent`` records of its host or more have it, or as many of three hosts, and at least ``share`` of them carry
    evidence of an error, filler or script-required page; so sentences that many real texts share are not. It is
    subtracted, as are runs of words that are such a line, and a record is excluded if its residual, but for a title line,
    consists of sentences with such evidence: made of the words of notices, or lines that ``recurrent`` records consist
    of. A record with a slot of a template left raw or empty anywhere is excluded, too. Null, empty and blank texts are
    never excluded here; null hosts count as one host.
    """
    some = df.where(F.col(key).isNotNull() & F.col(text).rlike(r"(?U)\S")).select(F.col(key).cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("")), F.col(text))
    scan = cut_lineage(some.mapInArrow(_scan, "doc_id long, host string, slot boolean, page boolean, rest string, lines array<long>, own array<boolean>"))
    line = scan.select("host", "page", (F.size("lines") == 1).alias("whole"), F.explode(F.arrays_zip("lines", "own")).alias("l")).select("host", "page", "whole", F.col("l.lines").alias("line"), F.col("l.own").alias("own"))
    by_host = line.groupBy("host", "line").agg(F.count("*").alias("n"), F.count_if("page").alias("pages"), F.bool_or("own").alias("own"), F.count_if("whole").alias("whole")).where("pages > 0")
    over_all = by_host.groupBy("line").agg(F.count("*").alias("hosts"), F.sum("n").alias("all_n"), F.sum("pages").alias("all_pages"), F.sum("whole").alias("whole"))
    counted = by_host.drop("whole").join(over_all, "line")
    of_host = (F.col("n") >= recurrent) & (F.col("pages") >= share * F.col("n"))
    of_all = (F.col("hosts") >= 3) & (F.col("all_n") >= recurrent) & (F.col("all_pages") >= share * F.col("all_n"))
    known = counted.where(of_host | of_all).where("not own or whole > 0").select("host", "line", "own", (F.col("whole") >= recurrent).alias("whole")).where("not own or whole")
    known = cut_lineage(known)
    pages = scan.where("page and not slot").select("doc_id", "host", "rest")
    if known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN:
        rows = known.collect()
        lists: dict[str, set[int]] = {}
        for r in rows:
            if not r.own:
                lists.setdefault(r.host, set()).add(r.line)
        whole = pages.mapInArrow(_judge({h: frozenset(v) for h, v in lists.items()}, frozenset(r.line for r in rows if r.own)), "doc_id long")
    else:
        row = ["doc_id", "host"]  # rows that share both look up in the same lines
        runs = pages.mapInArrow(_runs, "doc_id long, host string, line long").join(known.where("not own").select("host", "line"), ["host", "line"])
        held = runs.groupBy(row).agg(F.collect_set("line").alias("known"))
        lines = scan.where("page and not slot").select(*row, F.explode("lines").alias("line")).join(known.where("own").select("line").distinct(), "line")
        said = lines.groupBy(row).agg(F.collect_set("line").alias("said"))
        whole = pages.join(held, row, "left").join(said, row, "left").select(*row, "rest", "known", "said").mapInArrow(_judge(None, frozenset()), "doc_id long")
    return scan.where("slot").select("doc_id", F.lit("template").alias("reason")).unionByName(whole.select("doc_id", F.lit("page").alias("reason"))).distinct()


def p10_found(spark, sf_dir: str) -> DataFrame:
    """The documents to be excluded."""
    return find_residue(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select("doc_id").distinct()


def p10_clean(spark, sf_dir: str) -> DataFrame:
    """The clean corpus: documents with a text that has real content."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?U)\S"))
    return docs.join(p10_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "hotel_id", "source_type", "text")
