"""Worked examples, written by hand: what a rule makes of a text, and what the parser makes of a command line. {n} stands for a number of two digits."""

from __future__ import annotations

#: (rule, text, text after that rule alone)
RULES: list[tuple[str, str, str]] = [
    ("chrome_message", "x chrome.nativeMessaging.in.abcdef1234{n} y", "x chrome.nativeMessaging.in.<id> y"),
    ("chrome_pipe", r"\\.\pipe\chrome{n}", r"\\.chrome{n}"),
    ("chrome_extension", "chrome-extension://abcdefghijklmnopabcdefghijklmnop/ {n}", "<chrome_extension_id> {n}"),
    ("echo_pass", "echo 'Abcdef12345{n}' end", "echo <pass> end"),
    ("sha256", "h " + "ab" * 31 + "{n} e", "h <sha256> e"),
    ("dos_program_files", r"C:\PROGRA~1\x{n}", r"C:\Program Files\x{n}"),
    ("dos_program_data", r"c:/progra~3/x{n}", r"C:\ProgramData\x{n}"),
    ("dos_windows", r"C:\WINDOW~1\x{n}", r"C:\Windows\x{n}"),
    ("dos_name", r"D:\LONGNA~{n}\f", r"D:\LONGNA\f"),
    ("tmp_linux_ext", "cat /tmp/a{n}/b.sh now", "cat <tmp>.sh now"),
    ("tmp_linux", "cat /tmp/a{n} now", "cat <tmp> now"),
    ("caret_and", "cmd.exe a^&b {n}", "cmd.exe ab {n}"),
    ("caret", "cmd.exe n^et u^se {n}", "cmd.exe net use {n}"),
    ("cmd_separators", 'cmd.exe a,b;c "d,e" {n}', 'cmd.exe a b c "d,e" {n}'),
    ("backtick", "powershell.exe wr`ite 'a`b' {n}", "powershell.exe write 'a`b' {n}"),
    ("temp_ext", r"C:\Temp\a{n}\b.log", "<tmp>.log"),
    ("temp", r"C:\Temp\abc{n}", "<tmp>"),
    ("windows_temp_ext", r"c:\windows\temp\x{n}.exe", "<tmp>.exe"),
    ("windows_temp", r"c:\windows\temp\x{n}", "<tmp>"),
    ("users_temp_ext", r"C:\Users\bob\AppData\Local\Temp\x{n}.ps1", "<tmp>.ps1"),
    ("users_temp", r"C:\Users\bob\AppData\Local\Temp\x{n}", "<tmp>"),
    ("flag_cluster", "xcopy /E/I/Y {n}", "xcopy  /E /I /Y {n}"),
    ("registry", r"reg add hklm\Software\x{n} /v", r"reg add (<reg>hklm\Software\x{n}) /v"),
    ("unix_folders", "ls /etc/cron/x{n}.d end", r"ls <path>\.d end"),
    ("program_files", r"x C:\Program Files\a\b\run{n}.dll", r"x <program_files>\<path>\.dll"),
    ("program_data", r"x C:\ProgramData\Vendor\a\b{n}.log", r"x <ProgramData>\vendor\<path>\.log"),
    ("users", r"x C:\Users\bob\docs\a\b{n}.txt", r"x <Users>\<path>\.txt"),
    ("windows", r"x C:\Windows\System32\drivers\host{n}", r"x <Windows>\<path>\host"),
    ("drive_c", r"x C:\Tools\sub\a{n}.cfg y", r"x <C>\tools\<path>\.cfg y"),
    ("other_drives", r"x D:\data\sub\a{n}.csv", r"x <path>\<path>\.csv"),
    ("vcxproj", "msbuild app{n}.vcxproj", "msbuild <vcxproj>"),
    ("vs_version", "msbuild VisualStudioVersion={n}.0", "msbuild <vs_version>"),
    ("vs_configuration", "msbuild Configuration={n}", "msbuild <vs_configuration>"),
    ("vs_platform", "msbuild Platform={n}", "msbuild <vs_platform>"),
    ("linker_out", r"msvc /OUT:bin\x{n}.lib", r"msvc /out:<path>\.lib"),
    ("object_file", r"msvc a\b{n}.obj c.obj", r"msvc <path>\.obj .obj"),
    ("correlation_vector", "cv AbCdEfGhIjKlMnOp.{n}.2", "cv <id>"),
    ("unix_path", "run /home2/a/b/tool{n}.py", "run /home2/a/b/tool{n}.py"),
    ("v4_inside", "ping 10.0.{n}.1 or localhost", "ping <int_ip> or <int_ip>"),
    ("v4_outside", 'ping "8.8.{n}.8" 10.1.2.3', "ping <ext_ip> 10.1.2.3"),
    ("mac", "arp 00-1A-2b-3C-4d-{n} x", "arp <mac> x"),
    ("v6_inside", "ping fe80::{n} x", "ping <int_ip> x"),
    ("v6_outside", "ping 2001:db8::{n} x", "ping <ext_ip> x"),
    ("login", "ssh bob{n}@<ext_ip>", "ssh <user>@<ext_ip>"),
    ("ssh", r"cat a\.ssh\id_{n} x", r"cat a\.ssh\<ssh> x"),
    ("unc_host", r"copy \\server{n}\share\a\b.txt x", r"copy <host>\<path>\.txt x"),
    ("unc_address", r"copy \\<int_ip>\share\a\b{n}.txt x", r"copy <int_ip>\<path>\.txt x"),
    ("port_address_port", "fwd 80{n}:<int_ip>:4{n}", "fwd <port>:<int_ip>:<port>"),
    ("address_port", "at <ext_ip>:80{n} x", "at <ext_ip>:<port> x"),
    ("address_comma_port", "at <int_ip>,80{n} x", "at <int_ip>,<port> x"),
    ("tcp_host_port", "db tcp:Server_1,14{n} x", "db tcp:<host>,<port> x"),
    ("docker_port", "docker run  -p 80:{n} x", "docker run -p <port>:<port> x"),
    ("environment_call", "[x]::GetEnvironmentVariable( 'PA{n}' ) y", "[x]::getenvironmentvariable('<env>') y"),
    ("no_commit", "git diff " + "0" * 40 + " {n}", "git diff <commit_hash> {n}"),
    ("commit", "git show a1b2c{n} x", "git show <commit_hash> x"),
    ("port_option", "run --port '80{n}' x", "run --port <port> x"),
    ("port_option_equals", "run --port=80{n} x", "run --port=<port> x"),
    ("kill_port", "npx kill-port 80{n} x", "npx kill-port <port> x"),
    ("findstr_port", "findstr ':80{n}' x", "findstr ':<n>' x"),
    ("cursor", "display_cursor('abc{n}')", "display_cursor('<id>')"),
    ("port_equals", 'listenport = "80{n}" -UniversalPort 1{n}', "listenport = <port> -UniversalPort <port>"),
    ("metric", "metric = {n} x", "metric = <n> x"),
    ("interface", "interface='{n}' x", "interface=<n> x"),
    ("name_number", 'name="{n}" /pjob=1', "name=<n> /pjob=<n>"),
    ("sleep", "run 'sleep {n}.5' x", "run 'sleep <s>' x"),
    ("skip", "x -Skip {n} -seconds 1{n}", "x -Skip <n> -seconds <n>"),
    ("pid", "kill /PID eq {n} x", "kill /pid <PID> x"),
    ("compare", "x -eq {n} -Id 4", "x -eq <PID> -Id <PID>"),
    ("quoted_pid", 'x "pid <PID>" {n}', "x pid <PID> {n}"),
    ("process_id", 'where ProcessId != "{n}" x', "where ProcessId <PID> x"),
    ("parent_process_id", "where ParentProcessId={n} x", "where ParentProcessId <PID> x"),
    ("event_id", "where EventID='{n}' x", "where EventID <id> x"),
    ("find_pid", 'find "{n}" x', "find <PID> x"),
    ("code_page", "CHCP 12{n} x", "chcp <code> x"),
    ("api_key", "x -ApiKey Ab/c+{n}= y", "x -ApiKey <key> y"),
    ("key_option", 'x --key=ab{n} SecretKey=c"', 'x --key=<key> SecretKey=<key>"'),
    ("token_option", "x -token ab.c{n} MY_AUTH_TOKEN='q'", "x -token<token> MY_AUTH_TOKEN<token>"),
    ("pipe_name", "x -PipeName ab{n} y", "x -PipeName <id> y"),
    ("id_16", "x get-Abcdefghijklmn{n} y", "x get-<id> y"),
    ("hex_pair", "x 0123456789abcde{n}-fedcba9876543210 y", "x <id> y"),
    ("product_key", "x ab1{n}-abcde-fghij-klmno y", "x <key> y"),
    ("hex_24", "x 0123456789abcdef012345{n} y", "x <hex_id> y"),
    ("client_id", "x AB-{n}:0001:0002:00aF:0004 y", "x <client_id> y"),
    ("password", 'x Password="abc{n}" -password q', "x Password=<pass> -password <pass>"),
    ("username", "x user='bob{n}' y", "x user=<user> y"),
    ("url_password", "x session_pwd=ab!{n}&y", "x session_pwd=<pass>&y"),
    ("account_key", "x -acctkey ab{n} y", "x -acctkey <key> y"),
    ("arn", "x arn:aws:iam::12345{n}:role/x y", "x <arn> y"),
    ("encoded_params", "x --encoded_params=ab{n}= y", "x --encoded_params=<payload> y"),
    ("amp", 'x --amp="a b{n}.amp" y', "x --amp=<amp> y"),
    ("wmic_node", 'wmic /node:"host{n}" x', "wmic /node:<node> x"),
    ("wmic_process", "wmic process {n} x", "wmic process <PID> x"),
    ("wmic_interface", "wmic InterfaceIndex = {n} x", "wmic InterfaceIndex=<id> x"),
    ("current_date", "wscript CurDate=202501{n} x", "wscript CurDate=<date> x"),
    ("load_numbers", 'wscript LoadRepNo="1,{n}" x', "wscript LoadRepNo=<ids> x"),
    ("tries", "wscript /try:{n} x", "wscript /try:1 x"),
    ("install_key", "wscript -ipk AB1{n}-ABCDE-ABCDE-ABCDE-ABCDE x", "wscript -ipk <key> x"),
    ("duration", "x /duration {n} y", "x /duration <s> y"),
    ("bare_file", "run report{n}.xlsx now", "run .xlsx now"),
    ("guid", "x {550e8400-e29b-41d4-a716-4466554400{n}} y", "x <guid> y"),
    ("certificate", "x certhash = " + "ab" * 19 + "{n} y", "x certhash = <hash> y"),
    ("md5", "x " + "ab" * 15 + "{n} " + "1" * 30 + "{n} y", "x <md5> " + "1" * 30 + "{n} y"),
    ("long_token", "x " + "aB" * 23 + "{n} y", "x <token> y"),
    ("assignment", "$abc{n} = 5", "$<env> = 5"),
    ("email", "to a.b{n}@mail.example.org x", "to <email> x"),
    ("url", "get HTTPS://a.b/c?d={n} x", "get <url> x"),
    ("url_address", "get http://<ext_ip>:80{n}/a x", "get <url> x"),
    ("domain", "get www.a{n}.example.com/x/y z", "get <url> z"),
    ("url_port", "get <url>:80{n} x", "get <url>:<port> x"),
    ("variable_path", r"run %APPDATA%\x\y{n}.dat z", r"run <path>\.dat z"),
    ("relative", r"run ..\..\x{n}.sh z", r"run <path>\.sh z"),
    ("simple_relative", r"src\sub\x{n}.c z", r"<path>\.c z"),
    ("trailing_number", "run job_a{n} z", "run job_a z"),
    ("sid", "x S-1-5-21-{n} y", "x <SID> y"),
    ("timestamp", "x 17000000{n} y", "x <timestamp> y"),
    ("time_date", "x 1:{n}:30 PM 1/2/2025 y", "x <date> y"),
    ("date", "x 2025-01-{n}T10:11:12Z y", "x <date> y"),
    ("slash_date", "x 1/{n}/2025 y", "x <date> y"),
    ("time", "x 1:{n} am y", "x <date> y"),
    ("task_time", "x /ST {n}:30 y", "x /ST <date> y"),
    ("base64_call", "x FromBase64String('aGVsbG8gd29ybGQ=') {n}", "x hello world {n}"),
]

#: (command line, its tree as JSON)
COMMANDS: list[tuple[str, str]] = [
    (r"cmd.exe /c dir C:\Users\Public\Documents /s /b", '["cmd.exe", "/c", "dir", "<users>", "/s", "/b"]'),
    (r'powershell.exe -Command "Get-Content -Path C:\Logs\app.log -Tail {n}"', r'["powershell.exe", "-command", ["get-content", "-path", "<c><path>\\.log", "-tail", "<n>"]]'),
    (r"cmd.exe /c copy C:\temp\source{n}.txt C:\backup\dest.txt /Y", r'["cmd.exe", "/c", "copy", "<tmp>.txt", "<c><path>\\.txt", "/y"]'),
    (r"cmd.exe /c type C:\Windows\System32\drivers\etc\hosts | more", r'["cmd.exe", "/c", "type", "<windows>\\<path>\\hosts", "|", "more"]'),
    (r"cmd.exe /c xcopy C:\Source D:\Destination /E /I /Y", '["cmd.exe", "/c", "xcopy", "<c>", "<path>", "/e", ["ü"], "/y"]'),
    ('cmd.exe /c systeminfo | findstr /C:"OS Name" /C:"OS Version"', '["cmd.exe", "/c", "systeminfo", "|", "findstr", ["/c:os", "name"], ["/c:os", "version"]]'),
    ("cmd.exe /c wmic cpu get name, numberofcores, maxclockspeed", '["cmd.exe", "/c", "wmic", "cpu", "get", "name", "numberofcores", "maxclockspeed"]'),
    ('powershell.exe -Command "Get-Process | Sort-Object CPU -Descending | Select -First {n}"', '["powershell.exe", "-command", ["get-process", "|", "sort-object", "cpu", "-descending", "|", "select", "-first", "<n>"]]'),
    ("cmd.exe /c wmic service where \"startmode='Auto'\" get name, state", '["cmd.exe", "/c", "wmic", "service", "where", "startmode=\'auto", "get", "name", "state"]'),
    ('cmd.exe /c tasklist /FI "IMAGENAME eq notepad.exe" /V', '["cmd.exe", "/c", "tasklist", "/fi", ["imagename", "eq", "notepad.exe"], "/v"]'),
    (r"cmd.exe /c nslookup microsoft.com 8.8.{n}.8 > C:\temp\dns.txt", '["cmd.exe", "/c", "nslookup", "<url>", "<ext_ip>", ">", "<tmp>.txt"]'),
    ("cmd.exe /c tracert -h {n} -w 500 github.com", '["cmd.exe", "/c", "tracert", "-h", "<n>", "-w", "<n>", "<url>"]'),
    ("cmd.exe /c ver && echo Windows Directory is %WINDIR%", '["cmd.exe", "/c", "ver", "&&", "echo", "windows", "directory", "is", "%windir%"]'),
    ("run.exe out 2>&1 {n}", '["run.exe", "out", "<r>", "<n>"]'),
    ("powershell.exe -enc RwBlAHQALQBDAGgAaQBsAGQASQB0AGUAbQAgAEMAIABuAG8AdwA= {n}", '["powershell.exe", "-enc", ["get-childitem", "c", "now"], "<n>"]'),
    ('"C:\\p q\\tool.exe" "a b" {n}', r'["<c>\\p q\\tool.exe", ["a", "b"], "<n>"]'),
]
