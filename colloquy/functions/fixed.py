"""Word lists, phrases, patterns and thresholds that results depend on."""

import re

FILLERS_ZH = {
    "light": ["啊", "呃", "嗯", "额", "哦", "嘶", "emmm", "emm", "em"],
    "medium": ["那个", "就是", "然后", "嘿", "哈", "喂", "诶", "呢", "吧", "嘛", "呐", "唉"],
    "heavy": ["就是说", "对对对", "对对", "怎么说呢", "你知道吧", "反正就是", "说白了", "其实", "基本上", "所以说", "我觉得吧", "这个这个"],
}
FILLERS_EN = {
    "light": ["um", "uh", "uh huh", "hmm", "hm", "mm", "mmm", "er", "ah"],
    "medium": ["like", "you know", "i mean", "well", "so", "right", "okay", "ok"],
    "heavy": ["basically", "actually", "literally", "sort of", "kind of", "you know what i mean", "at the end of the day", "honestly", "to be honest", "in a sense", "if you will", "as it were"],
}
LEVELS = ["light", "medium", "heavy"]
FILLER_LANGUAGES_EN = ["um", "uh", "like", "basically", "actually", "literally"]
DENSITY_FILLERS_ZH = ["呃", "嗯", "啊", "额", "那个", "就是", "就是说", "然后", "对对对", "对对", "哦", "喂", "诶", "emmm"]
BLOCKED_EN = ["thank you for watching", "please subscribe", "like and subscribe", "thanks for watching", "subtitles by the amara.org community", "subtitles by amara.org", "this has been a voice memo", "please like and subscribe", "don't forget to subscribe", "click the bell icon", "leave a comment below", "link in the description", "sponsored by", "music", "applause"]
BLOCKED_ZH = ["这条语音备忘录已进行编辑", "请订阅我的频道", "字幕由Amara.org社区提供", "字幕由amara.org社区提供", "感谢观看", "谢谢观看", "请不要忘记点赞和订阅", "欢迎收看本期节目", "如果喜欢请点赞订阅", "字幕制作", "本视频由", "感谢收看", "请点击订阅", "由Amara.org社区提供", "请帮忙点赞", "音乐"]
HALLUCINATIONS = ["请订阅", "字幕由.*提供", "感谢.*观看", "语音备忘录已进行编辑", "并确认标签是正确的", "Thank you for watching", "Subscribe", "Subtitles by"]
MARKERS_ZH = ["然后", "另外", "还有", "接下来", "至于", "说到", "关于", "那个话题", "回到", "再说", "另外说", "那么", "现在", "还有就是", "另外再说"]
MARKERS_EN = ["by the way", "also", "another thing", "next", "about", "regarding", "moving on", "back to", "speaking of", "in addition", "furthermore"]
SENSITIVITY = {
    "low": {"repetition_ratio": 0.8, "min_confidence": 0.1, "max_overlap_ratio": 0.9, "max_segment_duration": 120.0, "min_repetition_count": 4},
    "medium": {"repetition_ratio": 0.6, "min_confidence": 0.2, "max_overlap_ratio": 0.7, "max_segment_duration": 90.0, "min_repetition_count": 3},
    "high": {"repetition_ratio": 0.4, "min_confidence": 0.3, "max_overlap_ratio": 0.5, "max_segment_duration": 60.0, "min_repetition_count": 2},
}
STATS_KEYWORDS = ["几次", "多少", "统计", "数量", "总共", "时长", "频率", "how many", "count", "total"]
ACTION_KEYWORDS = ["待办", "行动项", "任务", "todo", "action item", "to do"]
SPEAKER_KEYWORDS = ["发言人", "谁说", "说话", "speaker", "who said"]
MIME = {
    "pdf": "application/pdf",
    "doc": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "md": "text/markdown",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "wav": "audio/wav",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "json": "application/json",
    "csv": "text/csv",
}
CHINESE_DIGITS = "零一二三四五六七八九"
CJK_WIDE = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2EBEF}"
IDEOGRAPH = "[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]"
WIDE = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}"
TIDY = [(" {2,}", " "), (" ([，。、！？；：])", "$1"), (r"([，。、！？；：,.])\1+", "$1"), (r"^[，。、,.\s]+", "")]
KEPT_NUMBERS = [re.compile(p) for p in (r"\d{4}年", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"[vV]?\d+\.\d+(?:\.\d+)*", r"\d[\d\-]{9,}\d", r"[#＃]\d+", r"(?i)No\.\d+", r"\d+%", r"\d{4,}")]
TITLE_MARKS = "[\"'。.，,\n]"
WEEKDAYS = "日一二三四五六"
QUANTITIES = "[0-9一二三四五六七八九十百千万]+[美金元块%年月日天个台]+"
IMPERATIVES = "(?:你|我们|他)(?:先|要|去|可以|需要|应该)[^，。！？\n]{4,30}"
PHRASE_ZH = "[\\x{4E00}-\\x{9FA5}]{4,}"
STOP_WORDS = ["的", "了", "是", "在", "和", "与", "或", "这", "那", "个", "把", "被"]
SUMMARY_WEIGHTS = {"topics": 0.35, "actions": 0.30, "data": 0.20, "structure": 0.15}
LOCAL_ENGINES = {"zh": [(6.0, "qwen3", "qwen3-asr-1.7B"), (3.0, "qwen3", "qwen3-asr-0.6B"), (2.0, "paraformer", "paraformer-large")], "other": [(6.0, "whisper", "large-v3"), (4.0, "whisper", "medium"), (2.0, "whisper", "small"), (1.0, "whisper", "base")]}
CLOUD_ENGINES = {"alibaba": ("alibaba-asr", "paraformer-v2"), "openai": ("openai-whisper", "whisper-1"), "none": ("whisper", "tiny")}
SUMMARY_TITLES = {"conclusions": "结论", "decisions": "决策", "action_items": "待办事项", "discussion": "讨论要点", "technical_details": "技术细节", "next_steps": "下一步", "key_data": "关键数据", "participants": "参与者"}
TREE_IDS = {"conclusions": ("conclusions", "conclusion"), "action_items": ("actions", "action"), "decisions": ("decisions", "decision"), "discussion": ("discussion", "disc"), "technical_details": ("tech", "tech"), "next_steps": ("nextsteps", "next")}
