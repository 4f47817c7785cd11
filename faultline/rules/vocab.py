"""Dictionaries that turn ticket wording into technical keywords.  Fixed values."""

# Phrase contained in the ticket -> technical terms (intake dictionary).
INTAKE_PHRASES = {
    "freeze": ["deadlock", "hang", "timeout", "livelock"],
    "crash": ["segfault", "sigsegv", "null_deref", "abort", "terminate"],
    "hang": ["deadlock", "mutex_lock", "timeout", "blocked"],
    "stuck": ["deadlock", "hang", "blocking"],
    "unresponsive": ["hang", "deadlock", "cpu_spin"],
    "not responding": ["hang", "deadlock", "watchdog"],
    "black screen": ["framebuffer_fail", "display_init", "hdmi_handshake", "vdec_fail"],
    "no picture": ["video_fail", "vdec", "framebuffer", "display_off"],
    "flickering": ["vsync", "framebuffer", "gpu_hang", "tearing"],
    "distorted": ["codec_error", "bitrate", "decode_artifact"],
    "no sound": ["audio_fail", "adsp_crash", "codec_init_fail", "dsp_error"],
    "no audio": ["audio_fail", "adsp", "codec"],
    "mute": ["audio_mute", "adsp_fail"],
    "buffering": ["network_timeout", "bandwidth_limit", "cdn_fail", "buffer_underrun"],
    "not loading": ["network_timeout", "fetch_fail", "dns_fail", "connection_refused"],
    "slow": ["latency_high", "timeout", "packet_loss"],
    "loading": ["fetch_timeout", "manifest_parse", "network_error"],
    "reboot": ["spontaneous_reboot", "watchdog_reset", "kernel_panic"],
    "not turning on": ["boot_fail", "power_management", "init_fail"],
    "slow boot": ["init_slow", "service_timeout"],
    "remote": ["ir_routing", "keydown_event", "hid_fail"],
    "button": ["keydown", "ir_event", "input_fail"],
    "not working": ["input_fail", "service_crash", "init_fail"],
    "drm": ["widevine_l1", "hdcp_2_2", "eme_error", "drm_license"],
    "protected content": ["hdcp", "widevine", "security_fail"],
    "license": ["drm_license_fail", "widevine_license", "eme_fail"],
    "memory": ["oom", "malloc_fail", "heap_corrupt"],
    "out of memory": ["oom", "malloc_enobufs", "heap_exhausted"],
    "memory leak": ["leak", "event_listener", "heap_growth"],
}

# Component names kept as they are when they appear as whole words.
INTAKE_COMPONENTS = [
    "loki", "chromium", "vdec", "mali", "adsp", "mmc",
    "widevine", "hdcp", "eme", "ir", "watchdog", "directfb",
    "opengl", "gles", "surfaceflinger", "mediatek", "mtk",
    "netflix", "hulu", "amazon", "youtube", "pluto", "watchfree",
    "asan", "tsan", "ubsan", "oom",
]

# Regex -> terms.  All but the fifth ignore case.
INTAKE_CODES = [
    (r"(?i)SIGSEGV|signal 11", ["sigsegv", "null_deref", "segfault"]),
    (r"(?i)SIGABRT|signal 6", ["abort", "assert_fail"]),
    (r"(?i)SIGBUS|signal 7", ["sigbus", "misaligned_access"]),
    (r"(?i)OOM|out.of.memory", ["oom", "malloc_fail"]),
    (r"HDCP", ["hdcp_fail", "drm_fail"]),
    (r"(?i)widevine", ["widevine", "drm_fail"]),
    (r"(?i)mt5396|mt5670|mt5882", ["mediatek", "chipset"]),
    (r"(?i)addr2line|backtrace|tombstone", ["crash", "native_crash"]),
    (r"(?i)I/O error|EIO", ["io_error", "mmc_fail"]),
]

# Whole-word term -> technical keywords (context dictionary).
CONTEXT_TERMS = {
    "freeze": ["deadlock", "hang", "timeout", "race_condition", "mutex", "spinlock"],
    "freezes": ["deadlock", "hang", "timeout", "race_condition", "mutex", "spinlock"],
    "frozen": ["deadlock", "hang", "timeout", "race_condition", "mutex", "spinlock"],
    "hang": ["deadlock", "hang", "timeout", "race_condition"],
    "hangs": ["deadlock", "hang", "timeout", "race_condition"],
    "stuck": ["deadlock", "hang", "timeout", "race_condition"],
    "unresponsive": ["deadlock", "hang", "timeout", "event_loop"],
    "slow": ["performance", "latency", "memory_leak", "cpu_usage"],
    "crash": ["segfault", "sigsegv", "sigabrt", "exception", "abort", "core_dump"],
    "crashes": ["segfault", "sigsegv", "sigabrt", "exception", "abort", "core_dump"],
    "crashed": ["segfault", "sigsegv", "sigabrt", "exception", "abort", "core_dump"],
    "reboot": ["kernel_panic", "watchdog", "reboot", "crash"],
    "reboots": ["kernel_panic", "watchdog", "reboot", "crash"],
    "restart": ["crash", "abort", "restart", "exception"],
    "restarts": ["crash", "abort", "restart", "exception"],
    "black_screen": ["display_init", "gpu_fault", "video_decode", "hdmi", "framebuffer"],
    "black": ["display_init", "gpu_fault", "video_decode", "hdmi", "framebuffer"],
    "blank_screen": ["display_init", "gpu_fault", "video_decode", "hdmi"],
    "no_video": ["video_decode", "codec", "vdec", "gpu_fault"],
    "flickering": ["vsync", "framebuffer", "gpu_fault", "hdmi"],
    "tearing": ["vsync", "framebuffer", "gpu_fault"],
    "no_sound": ["audio_codec", "alsa", "dsp_crash", "audio_init", "hdmi_audio"],
    "no_audio": ["audio_codec", "alsa", "dsp_crash", "audio_init", "hdmi_audio"],
    "audio_stutter": ["audio_buffer", "underrun", "dsp_crash", "audio_sync"],
    "audio_delay": ["audio_sync", "latency", "audio_buffer"],
    "crackling": ["audio_buffer", "underrun", "audio_codec"],
    "buffering": ["network_timeout", "fetch_timeout", "bandwidth", "cdn"],
    "loading": ["network_timeout", "fetch_timeout", "cache", "latency"],
    "timeout": ["timeout", "fetch_timeout", "network_timeout", "connection"],
    "connection_error": ["network_timeout", "fetch_timeout", "socket", "connection"],
    "remote_not_working": ["ir_routing", "keydown", "event_handler", "input"],
    "button_not_responding": ["keydown", "event_handler", "input", "focus"],
    "no_input": ["ir_routing", "keydown", "event_handler", "input"],
    "drm_error": ["eme_drm", "widevine", "playready", "license", "cdm"],
    "license_error": ["eme_drm", "widevine", "playready", "license"],
    "playback_failed": ["video_decode", "codec", "mse", "drm", "eme"],
    "cant_play": ["video_decode", "codec", "drm", "eme", "mse"],
    "netflix_error": ["netflix_msl", "drm", "playback", "eme"],
    "hulu_error": ["hulu_ad", "mse", "playback"],
    "youtube_error": ["video_decode", "codec", "playback"],
    "companion_error": ["companion_lib", "timing_race", "init_failure"],
    "out_of_memory": ["heap_oom", "memory_leak", "malloc", "oom"],
    "memory_error": ["heap_oom", "memory_leak", "malloc", "segfault"],
    "leak": ["memory_leak", "fd_leak", "resource_leak"],
}

# Keyword weights; anything else weighs DEFAULT_KEYWORD_WEIGHT.
KEYWORD_WEIGHTS = {
    "segfault": 1.0, "sigsegv": 1.0, "sigabrt": 1.0, "kernel_panic": 1.0,
    "heap_oom": 1.0, "deadlock": 1.0,
    "timeout": 0.8, "race_condition": 0.8, "memory_leak": 0.8,
    "drm": 0.7, "eme": 0.7, "video_decode": 0.7,
    "error": 0.5, "warning": 0.3, "info": 0.2,
}
DEFAULT_KEYWORD_WEIGHT = 0.5

# Phrase contained in the description -> terms (log engine dictionary).
ENGINE_PHRASES = {
    "freeze": ["deadlock", "hang", "timeout", "livelock"],
    "crash": ["segfault", "sigsegv", "null_deref", "abort"],
    "hang": ["deadlock", "mutex", "lock", "timeout"],
    "stuck": ["deadlock", "hang", "blocking", "mutex"],
    "unresponsive": ["hang", "deadlock", "cpu_busy", "thread_block"],
    "black screen": ["framebuffer", "display_fail", "hdmi", "vdec"],
    "no picture": ["video_fail", "vdec", "framebuffer", "display"],
    "flickering": ["vsync", "framebuffer", "gpu_hang", "tearing"],
    "blurry": ["codec_fail", "bitrate", "resolution", "decode_error"],
    "no sound": ["audio_fail", "adsp_crash", "codec_init", "dsp_error"],
    "audio": ["adsp", "audio_codec", "pcm", "dsp_fail"],
    "mute": ["audio_mute", "adsp_fail", "volume_ctrl"],
    "buffering": ["network_timeout", "bandwidth", "cdn_fail", "buffer_underflow"],
    "not loading": ["network_timeout", "fetch_fail", "dns_fail", "connection_error"],
    "slow": ["latency", "timeout", "high_delay", "packet_loss"],
    "netflix": ["netflix_msl", "nrd", "dash_manifest", "cdn_fail"],
    "hulu": ["hulu_drm", "ad_mse", "hls_parse", "ad_insertion"],
    "amazon": ["amazon_dash", "prime_video", "drm_fail", "manifest"],
    "youtube": ["youtube_js", "yt_drm", "adaptive_streaming"],
    "watchfree": ["watchfree_deeplink", "hls_fail", "tuner"],
    "reboot": ["reboot", "restart", "watchdog", "kernel_panic"],
    "not turning on": ["boot_fail", "power_ctrl", "init_fail"],
    "slow boot": ["boot_time", "init_slow", "startup_fail"],
    "remote": ["ir_routing", "keydown", "hid_fail", "input_event"],
    "button": ["keydown", "ir_event", "input_fail"],
    "drm": ["widevine", "hdcp", "eme_fail", "drm_error", "license_fail"],
    "protected": ["hdcp", "widevine_l1", "security_fail"],
    "memory": ["oom", "malloc_fail", "heap_corrupt", "mmap_fail"],
    "out of memory": ["oom", "malloc_fail", "heap_exhausted"],
}

# Words tf-idf ignores.
STOP_WORDS = """
the a an and or but in on at to for of with by from as is was are be been
have has had do does did will would should could can may might must
this that these those it its i you he she we they what which who when where why how
log info debug warn warning error fatal trace line null undefined function object string
""".split()

# App name -> pattern on the lower-cased ticket, first match wins.
APP_PATTERNS = [
    ("Netflix", r"netflix"),
    ("Hulu", r"hulu"),
    ("Amazon", r"amazon|prime.video"),
    ("YouTube", r"youtube"),
    ("WatchFree", r"watchfree|watch.free"),
    ("Peacock", r"peacock"),
    ("Disney+", r"disney"),
    ("Max", r"\bmax\b|hbo.max"),
    ("Paramount+", r"paramount"),
    ("Pluto", r"pluto.tv"),
]

# Ticket priority names, upper-cased.
PRIORITY_NAMES = {
    "BLOCKER": "P0", "CRITICAL": "P0", "HIGHEST": "P0",
    "HIGH": "P1", "MEDIUM": "P2", "LOW": "P3", "LOWEST": "P3",
}
# Ticket priority names as the issue tracker spells them.
ISSUE_PRIORITY_NAMES = {
    "Blocker": "P0", "Critical": "P1", "Major": "P1", "High": "P1",
    "Medium": "P2", "Normal": "P2", "Low": "P3", "Minor": "P3", "Trivial": "P4",
}

# Substrings whose presence means the target error is still there.
TARGET_ERRORS_DEVICE = {
    "LOKI_SEGFAULT_NULL_DEREF": ["SIGSEGV", "signal 11", "0x00000000"],
    "COMPANION_LIB_TIMING": ["VIZIO_LIBRARY_DID_LOAD", "companion"],
    "SHAKA_ERROR_3016": ["Shaka", "3016"],
    "KEYDOWN_NOT_FIRED": ["keydown", "not dispatched"],
}
TARGET_ERRORS_BROWSER = {
    "COMPANION_LIB_TIMING": ["VIZIO_LIBRARY_DID_LOAD", "companion", "timing"],
    "SHAKA_ERROR_3016": ["Shaka", "3016", "BUFFER_READ_ERROR"],
    "NETFLIX_MSL_TIMEOUT": ["MSL", "timeout", "Netflix"],
    "EME_DRM_FAILURE": ["EME", "DRM", "keysystem"],
    "JS_HEAP_OOM": ["Out of memory", "heap", "OOM"],
}
GENERIC_ERROR_WORDS = ["error", "exception", "fatal", "segfault", "sigsegv", "sigabrt",
                       "assert", "panic", "crash"]

# Substring of an oops call trace -> subsystem, in order.
SUBSYSTEMS = [
    ("VDEC", ["mtk_vdec", "vdec_", "h264_decode", "hevc_decode", "vp9_decode", "av1_decode", "video_decoder"]),
    ("TRUSTZONE", ["trustzone", "tee_", "widevine", "optee", "tzdriver", "smc_call"]),
    ("MALI_GPU", ["mali", "kbase", "gpu_", "mali_kbase", "mali_gpu"]),
    ("HDMI", ["hdmi", "hdmitx", "hdcp", "edid", "cec"]),
    ("IR_INPUT", ["ir_", "input_event", "mtk_ir", "remote_control", "/dev/input"]),
    ("DIRECTFB", ["directfb", "dfb_", "surface_", "gfx_"]),
    ("MTK_FIRMWARE", ["mtk_", "mediatek", "bsp_"]),
]

# Minimum firmware, first firmware beyond the range, interface version,
# load event, version call, key table, speaks websocket.
VERSION_MATRIX = [
    ("5.0.0", "5.5.0", "v1.8.0", "COMPANION_READY", "getVersion()", "legacy_ir_keys", False),
    ("5.5.0", "5.9.0", "v1.9.0", "VIZIO_LIBRARY_DID_LOAD", "getLibraryVersion()", "ir_key_v2", False),
    ("5.9.0", "6.0.0", "v2.0.0", "VIZIO_LIBRARY_DID_LOAD", "getLibraryVersion()", "ir_key_v3", True),
    ("6.0.0", "99.0.0", "v2.1.0", "VIZIO_LIBRARY_DID_LOAD", "getLibraryVersion()", "ir_key_v3", True),
]

# Half-lives in days of the two decay rankings.
HALFLIFE_MEMORY = {
    "COMPANION_LIB_TIMING": 90,
    "EME_DRM_FAILURE": 120,
    "SHAKA_ERROR_3016": 180,
    "NETFLIX_MSL_TIMEOUT": 365,
    "LOKI_SEGFAULT_NULL_DEREF": 730,
    "LOKI_RACE_CONDITION": 730,
    "LOKI_MEMORY_CORRUPTION": 730,
    "DEFAULT": 365,
}
HALFLIFE_ROUTER = {
    "LOKI_SEGFAULT": 730, "HDMI_CEC_CONFLICT": 365, "DSP_AUDIO_DROPOUT": 365,
    "EME_DRM_FAILURE": 180, "WIDEVINE_PROVISIONING": 180,
    "COMPANION_LIB_TIMING": 90, "WEBSOCKET_CLOSE_4000": 90, "GRPC_DEADLINE_EXCEEDED": 90,
    "HTTP_CLIENT_TIMEOUT": 60, "DNS_RESOLUTION_TIMEOUT": 60,
    "NETFLIX_DIAL_MISMATCH": 45, "YOUTUBE_ATV_CODEC_ERR": 45,
    "OOM_FD_EXHAUSTION": 30, "MEMORY_LEAK": 30,
    "UNKNOWN": 90,
}
HALFLIFE_ROUTER_DEFAULT = 90

# The monitored dimension values.
MONITORED = {
    "app": ["netflix", "amazon_prime", "hulu", "watchfree", "disney_plus", "max", "youtube"],
    "layer": ["loki", "html5"],
    "chipset": ["mt5670", "mt5882", "mt5396"],
    "error_category": ["EME_DRM_FAILURE", "COMPANION_LIB_TIMING", "KEYDOWN_NOT_FIRED",
                       "LOKI_SEGFAULT_NULL_DEREF", "JS_HEAP_OOM"],
}

# Categories that always need a device run.
DEVICE_CATEGORIES = ["KEYDOWN_NOT_FIRED", "LOKI_APP_LAUNCH_FAILURE", "WATCHFREE_DEEPLINK_LOSS"]
